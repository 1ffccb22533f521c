"""Who reported an event first, and how many independent bodies did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Origins by the start of a source's id, and their order in reports.
PREFIXES = {"discord:": "discord", "relay:": "x", "x:": "x", "rss:": "rss", "edgar:": "edgar", "finnhub:": "wire"}
ORDER = ("x", "discord", "rss", "edgar", "wire", "other")


def origin_of(source_id: Column) -> Column:
    """Where a source's posts come from; what carried them does not count."""
    low = F.lower(F.trim(source_id))
    found = None
    for prefix, origin in PREFIXES.items():
        found = F.when(low.startswith(prefix), origin) if found is None else found.when(low.startswith(prefix), origin)
    return found.otherwise("other")


def _known(c: str | Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def attribute(posts: DataFrame) -> DataFrame:
    """Adds kind, label, identity, relayed_by and attribution_preserved to posts.

    Posts have source_id, source_name, org, author, origin_author, origin_channel,
    carrier, preserved, publisher and publisher_org.  A chat message is the
    original author's, never its carrier's; when the author was lost on the way
    the label says so.  An aggregator's item is its publisher's.  All else is the
    author's or the source's.
    """
    kind = origin_of(F.col("source_id"))
    kept = F.coalesce("preserved", F.lit(True))
    carrier = _known("carrier")
    lost = F.coalesce(F.concat(F.lit("unattributed via "), carrier), F.lit("unattributed"))
    author = F.coalesce(_known("origin_author"), _known("author"))
    chat = F.when(kept, F.coalesce(author, _known("origin_channel"), "source_name", "source_id")).otherwise(lost)
    publisher = _known("publisher")
    of_outlet = (kind == "wire") & publisher.isNotNull()
    label = (
        F.when(kind == "discord", chat).when(of_outlet, publisher)
        .otherwise(F.coalesce(_known("author"), "source_name", F.upper(kind)))
    )
    org = F.when(of_outlet, _known("publisher_org")).otherwise(_known("org"))
    relayed = F.when(kind == "discord", carrier).when(of_outlet, F.coalesce("source_name", "source_id"))
    return posts.withColumns(
        {
            "kind": kind, "label": label, "identity": F.coalesce(org, F.col("source_id")), "relayed_by": relayed,
            "attribution_preserved": (kind != "discord") | kept,
        }
    )


def provenance_of(contributors: DataFrame, event: str) -> DataFrame:
    """Per event: origins in order, label, confirmed_by, corroborated, first_reported_at.

    ``contributors`` has kind, label, identity, source_id and first_seen_at.  A source
    counts once, by its earliest report, before anything is collected, so what an
    event collects is bounded by its sources; bodies are counted by identity.
    """
    place = F.coalesce(F.col("first_seen_at").cast("timestamp"), F.lit("9999-12-31").cast("timestamp"))
    each = contributors.groupBy(event, "source_id").agg(
        F.min_by(F.struct("kind", "label", "identity"), F.struct(place, "label")).alias("s"), F.min("first_seen_at").alias("at")
    )
    order = F.coalesce("at", F.lit("9999-12-31").cast("timestamp"))
    rows = each.groupBy(event).agg(
        F.collect_set("s.kind").alias("kinds"),
        F.sort_array(F.collect_list(F.struct(order.alias("o"), "source_id", "s.label"))).alias("named"),
        F.count_distinct("s.identity").alias("confirmed_by"),
        F.min("at").alias("first_reported_at"),
    )
    origins = F.filter(F.array(*(F.lit(o) for o in ORDER)), lambda o: F.array_contains("kinds", o))
    return rows.select(
        event, F.array_join(origins, ",").alias("origins"), F.array_join(F.transform("named", lambda n: n["label"]), " + ").alias("label"),
        "confirmed_by", (F.col("confirmed_by") > 1).alias("corroborated"), "first_reported_at",
    )
