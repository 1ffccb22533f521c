"""Source health from poll outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Consecutive failures that disconnect, and the usual time between items in milliseconds.
DISCONNECT_AFTER, EXPECTED_MS = 3, 900_000


def health_state(failures: Column, since_item_ms: Column, ever_polled: Column, expected_ms: Column) -> Column:
    """Failures first, then how long no item came compared with what is expected; never polled counts as active."""
    return (
        F.when(failures >= DISCONNECT_AFTER, "DISCONNECTED")
        .when(failures > 0, "ERROR")
        .when(~ever_polled, "ACTIVE")
        .when(since_item_ms.isNull() | (since_item_ms > 3 * expected_ms), "STALE")
        .when(since_item_ms > expected_ms, "DELAYED")
        .otherwise("ACTIVE")
    )


def evaluate(polls: DataFrame, key: str, ts: str, ok: Column, items: Column, now: Column, expected_ms: Column | None = None) -> DataFrame:
    """State of each source at ``now`` from its polls: one aggregate, no window.

    Failures in a row are those after the last success, so they follow from two
    aggregates: the time of the last success, and the failures after it, found in
    a second aggregate over the rows joined with one row a source.
    """
    last = polls.groupBy(key).agg(
        F.max(F.when(ok, F.col(ts))).alias("last_success_at"),
        F.max(F.when(items > 0, F.col(ts))).alias("last_item_at"),
        F.max(F.when(~ok, F.col(ts))).alias("last_error_at"),
    )
    failed = polls.where(~ok).join(last.select(key, "last_success_at"), key)
    failed = failed.where(F.col("last_success_at").isNull() | (F.col(ts) > F.col("last_success_at")))
    failed = failed.groupBy(key).agg(F.count(F.lit(1)).alias("consecutive_failures"))
    rows = last.join(failed, key, "left").fillna(0, ["consecutive_failures"])
    since = F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col("last_item_at").cast("timestamp"))
    polled = F.col("last_success_at").isNotNull() | (F.col("consecutive_failures") > 0)
    expected = F.coalesce(expected_ms, F.lit(EXPECTED_MS)) if expected_ms is not None else F.lit(EXPECTED_MS)
    return rows.withColumn("state", health_state(F.col("consecutive_failures"), since, polled, expected))


def backoff_minutes(failures: Column) -> Column:
    """None before three failures, then 5 minutes doubling up to an hour."""
    return F.when(failures < 3, F.lit(0.0)).otherwise(F.least(F.lit(60.0), 5 * F.pow(F.lit(2.0), failures - 3)))


def retry_delay_seconds(attempt: Column) -> Column:
    """0, 1, 3 and then 10 seconds."""
    return F.when(attempt <= 0, 0).when(attempt == 1, 1).when(attempt == 2, 3).otherwise(10)
