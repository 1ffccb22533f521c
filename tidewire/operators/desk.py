"""Hand-over to desks: payloads as JSON, routes of relayed messages, a run's budget, and what may be logged."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys whose values are not logged, what stands in their place, and the depth beyond which nothing is told.
SECRET_KEY, REDACTED, MAX_DEPTH = "(?i)token|secret|password|authorization|api[_-]?key|cookie", "[redacted]", 6


def payload(events: DataFrame, sent_at: Column) -> DataFrame:
    """(event_id, payload) of published events: what a trading desk gets, as JSON.

    Events have id, event_id, slug, source_post_id, headline, body, category,
    subcategory, band, macro, relevance, market_moving, tickers, countries, names,
    published_at, detected_at and source_count; what is missing or null has its
    default.  A sink is idempotent by ``event_id``.
    """
    has = set(events.columns)

    def of(name: str, other: Column) -> Column:
        return F.coalesce(F.col(name), other) if name in has else other

    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    key = of("event_id", F.col("id").cast("string")).cast("string")
    body = F.struct(
        key.alias("eventId"), of("slug", F.lit("")).alias("slug"), of("source_post_id", none).alias("postId"), of("headline", F.lit("")).alias("headline"),
        of("body", F.lit("")).alias("body"), of("category", none).alias("category"), of("subcategory", none).alias("subcategory"),
        of("band", F.lit("LOW")).alias("severity"), of("macro", F.lit(False)).alias("macro"), of("relevance", F.lit("none")).alias("marketRelevance"),
        of("market_moving", F.lit(False)).alias("marketMoving"), of("tickers", empty).alias("tickers"), of("countries", empty).alias("countries"),
        of("names", empty).alias("entities"), of("published_at", F.lit(None).cast("timestamp")).cast("timestamp").alias("publishedAt"),
        of("detected_at", F.lit(None).cast("timestamp")).cast("timestamp").alias("detectedAt"), sent_at.cast("timestamp").alias("sentAt"),
        of("source_count", F.lit(1)).cast("int").alias("sourceCount"),
    )
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "timeZone": "UTC"}
    return events.select(key.alias("event_id"), F.to_json(body, options).alias("payload"))


def routed(messages: DataFrame, routes: DataFrame) -> DataFrame:
    """Messages (channel, author, text) with each destination that a route gives: an equi-join by channel.

    A route has channel, destination, and author and contains: parts of the author's
    name and of the text, whatever the case; null or empty fits all.  A message goes
    to a destination once, however many routes lead there.  Routes are broadcast only
    below Spark's own threshold.
    """
    part = lambda whole, piece: F.coalesce(piece, F.lit("")).eqNullSafe("") | F.contains(F.lower(F.coalesce(whole, F.lit(""))), F.lower(piece))
    rows = messages.alias("m").join(routes.alias("r"), F.col("m.channel") == F.col("r.channel"))
    fits = part(F.col("m.author"), F.col("r.author")) & part(F.col("m.text"), F.col("r.contains"))
    return rows.where(fits).select("m.*", F.col("r.destination").alias("destination")).distinct()


def within_run(due: DataFrame, order: list[str], seconds: str, budget: float, limit: int = 100) -> DataFrame:
    """The first ``limit`` of what is due, with ``deferred``: true from where the run's expected seconds exceed the budget.

    The limit is the run's own; beyond it the next run takes over, as it does with
    what is deferred.
    """
    first = due.orderBy(*order).limit(limit)
    spent = F.sum(seconds).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return first.withColumn("deferred", F.coalesce(spent, F.lit(0.0)) >= budget)


def since_time(text: Column, now: Column) -> Column:
    """A time ago (``30m``, ``2h``, ``7d``, ``45s``) or a time as such; null if it is neither."""
    n = F.regexp_extract(F.trim(text), "(?i)^(\\d{1,9})\\s*([smhd])$", 1)
    unit = F.lower(F.regexp_extract(F.trim(text), "(?i)^(\\d{1,9})\\s*([smhd])$", 2))
    seconds = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    ago = now.cast("timestamp") - F.make_dt_interval(secs=n.try_cast("double") * seconds)
    return F.when(n != "", ago).otherwise(F.try_to_timestamp(text))


def strings_of(c: Column) -> Column:
    """A JSON array's strings; empty for null, broken or other JSON."""
    return F.coalesce(F.filter(F.from_json(c, "array<string>"), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def masthead(source: Column) -> Column:
    """The name before a dash with blanks around it; null for an empty name."""
    name = F.nullif(F.trim(source), F.lit(""))
    return F.coalesce(F.nullif(F.trim(F.get(F.split(name, "\\s+[—–-]\\s+"), F.lit(0))), F.lit("")), name)


def _plain(value: object, depth: int = 0) -> object:
    if not isinstance(value, (dict, list)):
        return value
    if depth >= MAX_DEPTH:
        return "[truncated]"
    if isinstance(value, list):
        return [_plain(x, depth + 1) for x in value]
    return {k: REDACTED if re.search(SECRET_KEY, k) else _plain(v, depth + 1) for k, v in value.items()}


@F.pandas_udf(T.StringType())
def without_secrets(document: pd.Series) -> pd.Series:
    """A JSON document without values of keys that name secrets, and nothing below six levels; what is no JSON is told as such."""
    def told(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(_plain(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return '"[no json]"'

    return document.map(told)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, tolerance_ms: int, value: str = "match") -> DataFrame:
    """Each left row with the newest right row of its keys at or before its time, at most ``tolerance_ms`` old, as a struct.

    Both sides are cut into pieces of the tolerance's length.  Within a piece the
    newest right row before is carried along by a window; a left row without one
    looks at the last right row of the piece before.  So a key of many rows is many
    small groups, no pairs are made, and nothing is compared beyond the tolerance.
    """
    fields = [c for c in right.columns if c not in keys]
    ms = F.unix_millis(F.col(at).cast("timestamp"))
    a = left.select(F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(F.struct(*fields)).schema[0].dataType).alias("__right"), *keys, ms.alias("__ms"), F.lit(1).alias("__side"))
    b = right.select(F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.struct(*fields).alias("__right"), *keys, ms.alias("__ms"), F.lit(0).alias("__side"))
    both = a.union(b).withColumn("__piece", F.floor(F.col("__ms") / tolerance_ms))
    order = Window.partitionBy(*keys, "__piece").orderBy("__ms", "__side")
    found = F.struct(F.col("__ms").alias("ms"), F.col("__right").alias("right"))
    both = both.withColumn("__near", F.last(F.when(F.col("__side") == 0, found), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = both.where("__side = 0").groupBy(*keys, (F.col("__piece") + 1).alias("__piece")).agg(F.max_by(found, "__ms").alias("__before"))
    rows = both.where("__side = 1").join(last, [*keys, "__piece"], "left").withColumn("__best", F.coalesce("__near", "__before"))
    recent = F.col("__ms") - F.col("__best.ms") <= tolerance_ms
    return rows.select("__row.*", F.when(recent, F.col("__best.right")).alias(value))


def retained_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of each table."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in sorted(tables.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def verdict_changes(stored: DataFrame, again: DataFrame) -> DataFrame:
    """How posts (id, status, rejection_reason) fare now against how they were stored: was, now, n, and the share that is accepted now."""
    reason = lambda df: F.coalesce(df["rejection_reason"], df["status"])
    rows = stored.select("id", reason(stored).alias("was")).join(again.select("id", reason(again).alias("now"), (again["status"] == "PUBLISHED").alias("accepted")), "id")
    each = rows.groupBy("was", "now").agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("accepted"))
    return each.withColumn("acceptance_rate", F.col("accepted") / F.col("n")).drop("accepted")
