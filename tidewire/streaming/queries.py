"""Streaming jobs; each is a transformation of a stream, and a sink that can be run again without harm."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.operators.health import DISCONNECT_AFTER
from tidewire.sources.shared import work_dir


def land_stream(posts: DataFrame, keys: tuple[str, ...], ts: str, late: str = "1 hour") -> DataFrame:
    """Each post once, within the time that late arrivals are waited for; state is dropped after it."""
    return posts.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def hourly_metrics_stream(events: DataFrame, ts: str, metric: str, value: str, late: str = "10 minutes") -> DataFrame:
    """Count, sum, least and greatest by hour and metric; an hour is put out when no more can come."""
    rows = events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), F.col(metric).alias("metric"))
    rows = rows.agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    return rows.select(F.col("window.start").alias("bucket"), "metric", "n", "total", "least", "greatest")


def health_stream(polls: DataFrame) -> DataFrame:
    """Changes of state of sources from polls (source_id, ts, ok): failures in a row, connected or not.

    State is a count a source; it expires after a day of event time without polls.
    """
    state = "failures int, state string"
    out = "source_id string, ts timestamp, consecutive_failures int, state string"

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        failures, current = held.get if held.exists else (0, "ACTIVE")
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        changes = []
        for ts, ok in zip(rows["ts"], rows["ok"]):
            failures = 0 if ok else failures + 1
            new = "DISCONNECTED" if failures >= DISCONNECT_AFTER else "ERROR" if failures else "ACTIVE"
            if new != current:
                changes.append((key[0], ts, failures, new))
                current = new
        held.update((failures, current))
        held.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), held.getCurrentWatermarkMs()) + 24 * 3600 * 1000)
        if changes:
            yield pd.DataFrame(changes, columns=["source_id", "ts", "consecutive_failures", "state"])

    polls = polls.withWatermark("ts", "1 hour")
    return polls.groupBy("source_id").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def recent_duplicates_stream(posts: DataFrame, key: str, ts: str, minutes: int = 90) -> DataFrame:
    """Posts with an earlier post of equal key within the minutes: an interval join of the stream with itself."""
    late = posts.withWatermark(ts, f"{minutes} minutes").select(F.col("id").alias("id"), F.col(key).alias("_k"), F.col(ts).alias("post_ts"))
    early = posts.withWatermark(ts, f"{minutes} minutes").select(F.col("id").alias("earlier_id"), F.col(key).alias("_e"), F.col(ts).alias("earlier_ts"))
    on = (F.col("_k") == F.col("_e")) & (F.col("earlier_ts") < F.col("post_ts")) & (F.col("earlier_ts") >= F.col("post_ts") - F.expr(f"INTERVAL {minutes} MINUTES"))
    return late.join(early, on).select("id", "earlier_id", "post_ts", "earlier_ts")


def write_idempotent(stream: DataFrame, path: str, checkpoint: str, **trigger: Any):
    """Writes each micro-batch to a folder of its own number, so a batch that is run again replaces itself."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def drain(stream: DataFrame, path: str, spark: SparkSession) -> DataFrame:
    """Runs a stream over all that is there, and reads the result."""
    query = write_idempotent(stream, f"{path}/out", f"{path}/checkpoint", availableNow=True)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out").drop("batch")


def drain_in_pieces(rows: DataFrame, ts: str, job: Callable[[DataFrame], DataFrame], pieces: int = 3) -> DataFrame:
    """Runs a job over rows that arrive in order of time: a stream that is stopped after each piece of time, and goes on from its checkpoint."""
    spark, path = rows.sparkSession, work_dir(rows.sparkSession)
    low, high = rows.agg(F.min(F.unix_micros(F.col(ts).cast("timestamp"))), F.max(F.unix_micros(F.col(ts).cast("timestamp")))).first()
    at = F.floor((F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(low)) - F.lit(low)) * pieces / F.lit((high or 0) - (low or 0) + 1))
    found = None
    for i in range(pieces):
        rows.where(F.coalesce(at, F.lit(0)) == i).write.mode("append").parquet(f"{path}/in")
        found = drain(job(spark.readStream.schema(rows.schema).parquet(f"{path}/in")), path, spark)
    return found


def sessions_stream(events: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: events no further apart than the gap, put out when none can join any more; late ones merge sessions that they lie between."""
    rows = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), F.col(key).alias("key"))
    rows = rows.agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))
    return rows.select("key", "first_at", "last_at", "n")


def sliding_counts_stream(events: DataFrame, ts: str, key: str, length: str, step: str, late: str = "10 minutes") -> DataFrame:
    """Events by key in windows of a length that begin at every step, put out when a window can get no more."""
    rows = events.withWatermark(ts, late).groupBy(F.window(ts, length, step), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("key", F.col("window.start").alias("start"), "n")
