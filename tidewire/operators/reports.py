"""Reporting aggregates: counts, rollups, percentiles, source advice and rates.

Every aggregate combines on the map side; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys, the largest count first."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys)


def pivot_counts(df: DataFrame, key: str, status: str, statuses: Sequence[str]) -> DataFrame:
    """A column of counts for each status, 0 where there is none."""
    return df.groupBy(key).agg(*(F.count_if(F.col(status) == s).alias(s) for s in statuses))


def hourly_rollup(df: DataFrame, ts: str, metric: str, value: str, dims: Sequence[str] = ()) -> DataFrame:
    """Count, sum, least and greatest value by hour, metric and dimensions; an absent dimension is ''."""
    keys = [F.date_trunc("hour", F.col(ts)).alias("bucket"), F.col(metric).alias("metric")]
    keys += [F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d) for d in dims]
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest")
    )


def metric_summary(df: DataFrame, metric: str, category: str, value: str) -> DataFrame:
    """Totals by metric, and by metric and category, in one pass of grouping sets; a metric's own row has no category."""
    df = df.select(F.col(metric).alias("metric"), F.col(category).alias("category"), F.col(value).alias("value"))
    return df.groupingSets([["metric"], ["metric", "category"]], "metric", "category").agg(
        F.grouping("category").cast("int").alias("is_total"), F.count("value").alias("n"), F.sum("value").alias("total")
    )


def percentiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles with count and mean of known values; groups without any have 0."""
    def rank(p: float) -> Column:
        return F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})"), F.lit(0.0))

    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
        *(rank(p).alias(f"p{round(p * 100)}") for p in at),
    )


def advice(received: Column, quality: Column, ratio: Column) -> Column:
    """KEEP with too little traffic to judge; else by quality and useful share."""
    return (
        F.when(received < 25, "KEEP")
        .when((quality < 70) | (ratio < 0.05), "REMOVE")
        .when((quality < 85) | (ratio < 0.15), "REVIEW")
        .otherwise("KEEP")
    )


def source_report(sources: DataFrame, posts: DataFrame, key: str, status: str, accepted: str = "PUBLISHED", duplicate: str = "DUPLICATE") -> DataFrame:
    """Counters, useful share and advice for each source, also those without posts.

    Posts are counted before the join, so the join has a row a source.
    """
    counts = posts.groupBy(key).agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(F.col(status) == accepted).alias("accepted"),
        F.count_if(F.col(status) == duplicate).alias("duplicates"),
    )
    rows = sources.join(counts, key, "left").fillna(0, ["received", "accepted", "duplicates"])
    ratio = F.col("accepted") / F.greatest(F.col("received"), F.lit(1))
    rows = rows.withColumn("rejected", F.col("received") - F.col("accepted") - F.col("duplicates")).withColumn("useful_ratio", ratio)
    rows = rows.withColumn("suggestion", advice(F.col("received"), F.col("quality_score"), F.col("useful_ratio")))
    return rows.orderBy(F.desc("useful_ratio"), F.desc("accepted"), key)


def pipeline_rates(posts: DataFrame, status: str) -> DataFrame:
    """Shares of duplicates and rejections, over at least one post."""
    total = F.greatest(F.count(F.lit(1)), F.lit(1))
    return posts.agg(
        F.count_if(F.col(status) == "PUBLISHED").alias("alerts_sent"),
        (F.count_if(F.col(status) == "DUPLICATE") / total).alias("duplicate_rate"),
        (F.count_if(F.col(status).isin("FILTERED", "BELOW_THRESHOLD")) / total).alias("rejection_rate"),
    )


def corroboration(reports: DataFrame, event: str, org: str, source: str) -> DataFrame:
    """How many organisations confirm an event; a source without one stands for itself."""
    who = F.coalesce(F.col(org).cast("string"), F.col(source).cast("string"))
    return reports.groupBy(event).agg(F.countDistinct(who).alias("confirmed_by"))


def contributors(reports: DataFrame, event: str, identity: str, seen: str, fill: Sequence[str]) -> DataFrame:
    """One row an event and reporter: first seen, and the earliest known value of each other column; of values at one time the least."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(seen), F.col(c).alias("value")))).alias(c) for c in fill]
    return reports.groupBy(event, identity).agg(F.min(seen).alias("first_seen_at"), *first)


def newest_per_key(df: DataFrame, key: str, ts: str, n: int, tie: str) -> DataFrame:
    """The newest n rows of each key; Spark drops the rest before the shuffle (window group limit)."""
    order = Window.partitionBy(key).orderBy(F.desc(ts), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def newest(df: DataFrame, ts: str, limit: int, tie: str, most: int = 5000) -> DataFrame:
    """The newest rows, between 1 and ``most``."""
    return df.orderBy(F.desc(ts), F.asc(tie)).limit(min(max(limit, 1), most))


def best_by(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """The row of the greatest score of each key, the later of equals, as an aggregate (no sort)."""
    cols = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*cols), F.struct(F.col(score), F.col(tie)))
    return df.groupBy(key).agg(best.alias("_best")).select(key, "_best.*")


def running_peak(df: DataFrame, key: str, ts: str, value: str, label: str, tie: str) -> DataFrame:
    """The greatest value so far in each key, and the label that came with it first."""
    order = Window.partitionBy(key).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    at = F.max_by(F.struct(F.col(label)), F.struct(F.col(value), -F.unix_micros(F.col(ts).cast("timestamp")), -F.col(tie)))
    return df.withColumn("peak", F.max(value).over(order)).withColumn("peak_label", at.over(order)[label])


def failure_runs(df: DataFrame, key: str, ts: str, ok: Column, tie: str) -> DataFrame:
    """Consecutive failures up to each row: counted since the last success before it."""
    order = Window.partitionBy(key).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_island", F.sum(F.when(ok, 1).otherwise(0)).over(order)).withColumn("_bad", F.when(ok, 0).otherwise(1))
    run = Window.partitionBy(key, "_island").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("consecutive_failures", F.sum("_bad").over(run)).drop("_island", "_bad")


def sessions(df: DataFrame, key: str, ts: str, gap_minutes: int, tie: str) -> DataFrame:
    """Runs of rows of a key without a gap above the limit: number, first, last and rows."""
    order = Window.partitionBy(key).orderBy(ts, tie)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(order)
    df = df.withColumn("_new", F.when(gap.isNull() | (gap > gap_minutes * 60_000_000), 1).otherwise(0))
    df = df.withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(key, "session").agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("n"))


def within_budget(df: DataFrame, keys: Sequence[str], order: Sequence[str], cost: str, limit: float) -> DataFrame:
    """Whether the running cost of a key, this row included, is within the limit."""
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(run)).withColumn("granted", F.col("spent") <= limit)


def debounced(df: DataFrame, key: str, ts: str, minutes: int = 30) -> DataFrame:
    """Adds ``warn``: the first of a key's warnings, and each that follows the last one shown by ``minutes`` or more.

    Which was shown last depends on those before, so a fold in order decides.  A
    warning after a gap of ``minutes`` is shown in any case, so only the distinct
    times between two such gaps are folded together.
    """
    order = Window.partitionBy(key).orderBy(ts)
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    rows = df.withColumn("_ms", ms)
    gap = F.col("_ms") - F.lag("_ms").over(order)
    rows = rows.withColumn("_run", F.sum(F.when(gap.isNull() | (gap >= minutes * 60_000), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    times = rows.groupBy(key, "_run").agg(F.sort_array(F.collect_set("_ms")).alias("_all"))
    fold = F.aggregate(
        "_all", F.array().cast("array<bigint>"),
        lambda a, t: F.when((F.size(a) == 0) | (t - F.try_element_at(a, F.lit(-1)) >= minutes * 60_000), F.concat(a, F.array(t))).otherwise(a),
    )
    shown = times.select(key, F.explode(fold).alias("_ms"), F.lit(True).alias("warn"))
    first = F.row_number().over(Window.partitionBy(key, "_ms").orderBy(F.lit(1))) == 1
    return rows.join(shown, [key, "_ms"], "left").withColumn("warn", F.coalesce("warn", F.lit(False)) & first).drop("_ms", "_run")


def events_per_minute(df: DataFrame, ts: str, started: Column, now: Column, published: Column) -> DataFrame:
    """Published events of the last day, a minute of that day or of the time since the start if that is less."""
    day = F.make_dt_interval(days=F.lit(1))
    minutes = F.least(F.lit(1440.0), (F.unix_millis(now.cast("timestamp")) - F.unix_millis(started.cast("timestamp"))) / 60000.0)
    n = df.where(F.col(ts) >= now - day).agg(F.count_if(published).alias("published"))
    return n.select("published", F.round(F.col("published") / F.greatest(F.lit(1.0), minutes), 3).alias("events_per_minute"))


def metrics_document(events: DataFrame, deliveries: DataFrame, health: DataFrame, ts: str, now: Column) -> DataFrame:
    """One row of JSON over the last day: events by status and rejection, deliveries by destination and status, sources by state.

    Each part is an aggregate of a few rows before they meet.
    """
    since = now - F.make_dt_interval(days=F.lit(1))

    def counts(df: DataFrame, name: str, *keys: str) -> DataFrame:
        label = F.concat_ws("/", *(F.coalesce(F.col(k), F.lit("")) for k in keys))
        each = df.groupBy(label.alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return each.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("v")).select(F.lit(name).alias("part"), "v")

    recent = events.where(F.col(ts) >= since)
    parts = counts(recent, "events", "status")
    parts = parts.union(counts(recent.where("rejection_reason IS NOT NULL"), "rejections", "rejection_reason"))
    parts = parts.union(counts(deliveries.where(F.col("created_at") >= since), "deliveries", "destination", "status"))
    parts = parts.union(counts(health, "health", "state"))
    whole = F.map_from_entries(F.sort_array(F.collect_list(F.struct("part", F.to_json("v").alias("v")))))
    return parts.agg(whole.alias("m")).select(
        *(F.element_at("m", p).alias(p) for p in ("deliveries", "events", "health", "rejections"))
    )
