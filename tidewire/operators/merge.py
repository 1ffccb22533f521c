"""Keyed upserts, priming, retention and other set differences, as joins and aggregates over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str, keep_known: Sequence[str] = ()) -> DataFrame:
    """The newest row of each key; columns of ``keep_known`` keep their last known, non-empty value."""
    rows = current.unionByName(incoming)
    others = [c for c in rows.columns if c not in keys]
    last = [
        F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(version))).alias(c) if c in keep_known
        else F.max_by(c, version).alias(c)
        for c in others
    ]
    return rows.groupBy(*keys).agg(*last).select(*rows.columns)


def sticky_first(rows: DataFrame, keys: Sequence[str], order: str, first: Sequence[str], last: Sequence[str]) -> DataFrame:
    """One row a key: the first known value of some columns, the last known of others."""
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    return rows.groupBy(*keys).agg(
        *(F.min_by(c, known(c)).alias(c) for c in first), *(F.max_by(c, known(c)).alias(c) for c in last)
    )


def sync_sources(live: DataFrame, config: DataFrame, key: str = "id", preserved: Sequence[str] = ("verified", "created_at")) -> DataFrame:
    """Configured sources with what is preserved of live ones; live ones no longer configured stay, disabled."""
    a, b = live.alias("a"), config.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    cols = []
    for c in config.columns:
        old = F.col(f"a.{c}") if c in live.columns else F.lit(None)
        if c == "enabled":
            cols.append(F.when(F.col(f"b.{key}").isNull(), F.lit(False)).otherwise(F.col("b.enabled")).alias(c))
        elif c in preserved:
            cols.append(F.coalesce(old, F.col(f"b.{c}")).alias(c))
        else:
            cols.append(F.when(F.col(f"b.{key}").isNull(), old).otherwise(F.col(f"b.{c}")).alias(c))
    return joined.select(*cols)


def prime(posts: DataFrame, primed: DataFrame, key: str = "source_id") -> DataFrame:
    """Adds ``publish``: false for posts of sources seen for the first time in this batch."""
    known = primed.select(key).distinct().withColumn("_known", F.lit(True))
    return posts.join(known, key, "left").withColumn("publish", F.coalesce("_known", F.lit(False))).drop("_known")


def orphans(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents without a child."""
    return parents.join(children.select(F.col(child_key).alias(parent_key)), parent_key, "left_anti")


def retain(df: DataFrame, ts: str, now: Column, days: int, newest: int | None = None) -> DataFrame:
    """Rows of the last days; of these the newest so many, by a threshold found in an aggregate rather than a global sort."""
    kept = df.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))
    if newest is None:
        return kept
    by_ts = kept.groupBy(ts).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc(ts)).limit(newest)
    return kept.join(by_ts.select(ts), ts, "left_semi").orderBy(F.desc(ts)).limit(newest)


def account(df: DataFrame, **conditions: Column) -> DataFrame:
    """How many rows meet each condition."""
    return df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in conditions.items()))


def uncovered(routed: Column, covered: Column) -> Column:
    """Channels routed to that have no message yet, in order."""
    return F.array_except(routed, covered)
