"""Sending again what was not delivered, as one batch: what is due, what became of it, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.times import freshness

#: A delivery that stays pending longer was abandoned; a claim of another run lapses after so long.
STALE_PENDING_MINUTES, STALE_CLAIM_MINUTES = 5, 10


def due_deliveries(deliveries: DataFrame, now: Column, destination: str, status: str = "FAILED", since: Column | None = None) -> DataFrame:
    """Deliveries to a destination that failed, or are pending for too long, and that no other run has claimed lately."""
    before = lambda minutes: now - F.make_dt_interval(mins=F.lit(minutes))
    abandoned = (F.col("status") == "PENDING") & (F.col("created_at") < before(STALE_PENDING_MINUTES))
    free = F.col("claimed_at").isNull() | (F.col("claimed_at") < before(STALE_CLAIM_MINUTES))
    rows = deliveries.where((F.col("destination") == destination) & ((F.col("status") == status) | abandoned) & free)
    return rows if since is None else rows.where(F.col("created_at") >= since)


def representatives(events: DataFrame) -> DataFrame:
    """Of each ``event_id`` the post of the highest importance; a tie goes to the least id."""
    cols = [c for c in events.columns if c != "event_id"]
    rows = events.groupBy("event_id").agg(F.max_by(F.struct(*cols), F.struct(F.coalesce("importance", F.lit(-1.0)), -F.col("id"))).alias("e"))
    return rows.select("event_id", *(F.col("e")[c].alias(c) for c in cols))


def replay_outcomes(due: DataFrame, events: DataFrame, now: Column, max_age_minutes: float) -> DataFrame:
    """Per due delivery: event_id, headline, published_at, result, reason.

    The original publication time decides whether an event is still worth
    sending.  Events no longer stored are UNRESOLVABLE, late or undated ones
    SKIPPED; the rest are READY, for a sink that is idempotent by event_id.
    """
    wanted = due.select("event_id").distinct()
    # Only the posts of due events are brought together, so the rest of the history isn't shuffled.
    best = representatives(events.join(wanted, "event_id", "left_semi"))
    rows = wanted.join(best, "event_id", "left").withColumn("f", freshness(F.col("published_at"), now, max_age_minutes))
    missing = F.col("id").isNull()
    return rows.select(
        "event_id", "headline", "published_at",
        F.when(missing, "UNRESOLVABLE").when(F.col("f.fresh"), "READY").otherwise("SKIPPED").alias("result"),
        F.when(missing, "no stored event").otherwise(F.col("f.reason")).alias("reason"),
    )


def replay_report(outcomes: DataFrame) -> DataFrame:
    """One row of counts."""
    of = lambda r: F.count_if(F.col("result") == r)
    unknown = F.count_if((F.col("result") == "SKIPPED") & (F.col("reason") == "unknown"))
    return outcomes.agg(
        F.count(F.lit(1)).alias("candidates"), of("READY").alias("ready"), of("SKIPPED").alias("skipped"),
        unknown.alias("skipped_unknown_time"), of("UNRESOLVABLE").alias("unresolvable"),
    )


def alert_actions(alerts: DataFrame, messages: DataFrame) -> DataFrame:
    """What a sink has to do per event and channel: EDIT a message that stands, POST to a channel without one, NONE if nothing changed.

    ``alerts`` has event_id, channels (array), content and supersedes; ``messages``
    event_id, channel, message_id and content.
    """
    each = alerts.select("event_id", F.explode("channels").alias("channel"), "content", "supersedes")
    sent = messages.select("event_id", "channel", "message_id", F.col("content").alias("_sent"))
    rows = each.join(sent, ["event_id", "channel"], "left")
    action = (
        F.when(F.col("message_id").isNull(), "POST")
        .when(F.coalesce("supersedes", F.lit(False)) & ~F.col("content").eqNullSafe(F.col("_sent")), "EDIT").otherwise("NONE")
    )
    return rows.select("event_id", "channel", "message_id", "content", action.alias("action"))
