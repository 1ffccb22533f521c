"""Mergeable sketches: quantiles and distinct counts by hour, stored once and merged over any range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a quantile sketch (rank error about 1.33 % at 200, with 99 % confidence), and of a distinct-count sketch as a power of two (error about 1.6 %).
KLL_K, HLL_LG = 200, 12


def hourly_sketches(rows: DataFrame, ts: str, keys: Sequence[str], value: str, member: str) -> DataFrame:
    """One row an hour and key: ``n``, a quantile sketch of the values and a distinct-count sketch of the members.

    A row is some kilobytes however many events its hour has, and sketches of tasks
    are merged before the shuffle.  Null values and members are in neither sketch.
    """
    bucket = F.date_trunc("hour", F.col(ts)).alias("bucket")
    return rows.groupBy(bucket, *keys).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("quantiles"), F.hll_sketch_agg(F.col(member), HLL_LG).alias("members")
    )


def _between(sketches: DataFrame, start: Column | None, end: Column | None) -> DataFrame:
    rows = sketches if start is None else sketches.where(F.col("bucket") >= start)
    return rows if end is None else rows.where(F.col("bucket") < end)


def percentile_range(sketches: DataFrame, keys: Sequence[str], shares: Sequence[float], start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Estimated quantiles (``p50`` and its like) by key over hours from ``start`` to before ``end``."""
    merged = _between(sketches, start, end).groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("_q"))
    estimates = [F.kll_sketch_get_quantile_double("_q", F.lit(float(p))).alias(f"p{round(p * 100)}") for p in shares]
    return merged.select(*keys, "n", *estimates)


def distinct_range(sketches: DataFrame, keys: Sequence[str], start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Estimated numbers of different members by key over hours from ``start`` to before ``end``."""
    merged = _between(sketches, start, end).groupBy(*keys).agg(F.hll_union_agg("members").alias("_m"))
    return merged.select(*keys, F.hll_sketch_estimate("_m").alias("members"))
