"""Registered queries over the driver's tables, each beside its SQL.

The tables hold no news, so stand-ins carry the meaning: users are sources, event
types are statuses or outcomes of polls, documents are posts, parts are events
that suppliers report.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.functions import times as T
from tidewire.functions.figures import extract_figures
from tidewire.functions.simhash import simhash64, text_simhash64, text_words
from tidewire.functions.sql_surface import register_sql
from tidewire.functions.terms import with_terms
from tidewire.functions.urls import canonical_url, post_ids
from tidewire.operators import buckets, calendar, classify, cluster, dedupe, desk, earnings, extract, health, impact, merge, provenance, render, replay, reports, score, sketches
from tidewire.plans import posts as P
from tidewire.plans import sql as Q
from tidewire.plans.lexicons import SAMPLE
from tidewire.sources import feeds, relay
from tidewire.sources.shared import spread, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Fixed times in the range of the events.
NOW, SINCE = "2024-01-30 12:00:00", "2024-01-15 00:00:00"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table; texts, on which most work is done row by row, over all cores however few their files are."""
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def r4(c: Column) -> Column:
    return F.round(c, 4)


@query("status_counts", f"SELECT event_type, count(*) AS n FROM events WHERE ts >= '{SINCE}' GROUP BY 1")
def _(s, d):
    return reports.counts_by(table(s, d, "events").where(F.col("ts") >= ts(SINCE)), "event_type")


@query("rejection_counts", f"""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN value IS NULL THEN 'EMPTY_TEXT' WHEN event_type = 'error' THEN 'SOURCE_DISABLED'
  WHEN value < 5 THEN 'BELOW_THRESHOLD' WHEN ts < '{SINCE}' THEN 'NOISE_OLD_NEWS' END AS reason FROM events)
WHERE reason IS NOT NULL GROUP BY 1""")  # fmt: skip
def _(s, d):
    reason = score.first_rejection(
        (F.col("value").isNull(), "EMPTY_TEXT"), (F.col("event_type") == "error", "SOURCE_DISABLED"),
        (F.col("value") < 5, "BELOW_THRESHOLD"), (F.col("ts") < ts(SINCE), "NOISE_OLD_NEWS"),
    )
    return reports.counts_by(table(s, d, "events").withColumn("reason", reason).where("reason IS NOT NULL"), "reason")


@query("gate_cascade", """
SELECT event_id, reason, CASE WHEN reason IS NULL THEN 'PUBLISHED' WHEN starts_with(reason, 'DUPLICATE') THEN 'DUPLICATE'
  WHEN reason = 'BELOW_THRESHOLD' THEN 'BELOW_THRESHOLD' ELSE 'FILTERED' END AS status
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'SOURCE_DISABLED' WHEN event_id % 7 = 3 THEN 'DUPLICATE_URL'
  WHEN event_id % 11 = 5 THEN 'NO_CATEGORY' WHEN value < 50 THEN 'BELOW_THRESHOLD' END AS reason FROM events)""")
def _(s, d):
    reason = score.first_rejection(
        (F.col("event_type") == "error", "SOURCE_DISABLED"), (F.col("event_id") % 7 == 3, "DUPLICATE_URL"),
        (F.col("event_id") % 11 == 5, "NO_CATEGORY"), (F.col("value") < 50, "BELOW_THRESHOLD"),
    )
    df = table(s, d, "events").select("event_id", reason.alias("reason"))
    return df.withColumn("status", score.status_of(F.col("reason")))


@query("delivery_breakdown", """
SELECT o_orderpriority, count_if(o_orderstatus = 'O') AS "O", count_if(o_orderstatus = 'F') AS "F", count_if(o_orderstatus = 'P') AS "P"
FROM orders GROUP BY 1""")
def _(s, d):
    return reports.pivot_counts(table(s, d, "orders"), "o_orderpriority", "o_orderstatus", ["O", "F", "P"])


@query("queue_depth", "SELECT count(*) AS n, count_if(o_orderstatus = 'O') AS queued, count_if(o_orderstatus = 'P') AS pending FROM orders")
def _(s, d):
    status = F.col("o_orderstatus")
    return merge.account(table(s, d, "orders"), queued=status == "O", pending=status == "P")


@query("hourly_metrics", """
SELECT date_trunc('hour', ts) AS bucket, event_type AS metric, count(value) AS n, round(sum(value), 4) AS total, min(value) AS least,
  max(value) AS greatest FROM events GROUP BY 1, 2""")
def _(s, d):
    return reports.hourly_rollup(table(s, d, "events"), "ts", "event_type", "value").withColumn("total", r4(F.col("total")))


@query("metric_summary", """
SELECT metric, CAST(category AS INTEGER) AS category, CAST(grouping(category) AS INTEGER) AS is_total, count(value) AS n, round(sum(value), 4) AS total
FROM (SELECT event_type AS metric, CAST(user_id % 10 AS INTEGER) AS category, value FROM events)
GROUP BY GROUPING SETS ((metric), (metric, category))""")
def _(s, d):
    df = table(s, d, "events").withColumn("cat", (F.col("user_id") % 10).cast("int"))
    return reports.metric_summary(df, "event_type", "cat", "value").withColumn("total", r4(F.col("total")))


@query("latency_percentiles", """
SELECT event_type, count(value) AS n, round(coalesce(avg(value), 0), 4) AS mean, coalesce(quantile_disc(value, 0.5), 0) AS p50,
  coalesce(quantile_disc(value, 0.95), 0) AS p95, coalesce(quantile_disc(value, 0.99), 0) AS p99 FROM events GROUP BY 1""")
def _(s, d):
    return reports.percentiles(table(s, d, "events"), ["event_type"], "value").withColumn("mean", r4(F.col("mean")))


@query("latency_legs", """
SELECT o_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN greatest(0, CAST(epoch_ms(l_shipdate) - epoch_ms(o_orderdate) AS BIGINT)) END AS leg_ms
FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def _(s, d):
    df = table(s, d, "orders").join(table(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    published = F.when(F.col("l_returnflag") != "N", F.col("o_orderdate"))
    return df.select("o_orderkey", "l_linenumber", T.leg(published, F.col("l_shipdate")).alias("leg_ms"))


@query("freshness_gate", f"""
SELECT event_id, reason IS NULL AS fresh, reason FROM (SELECT event_id, CASE WHEN published IS NULL THEN 'unknown'
  WHEN epoch_us(TIMESTAMP '{NOW}') // 1000 - epoch_us(published) // 1000 > 14 * 86400000 THEN 'stale'
  WHEN epoch_us(TIMESTAMP '{NOW}') // 1000 - epoch_us(published) // 1000 < -300000 THEN 'future' END AS reason
  FROM (SELECT event_id, CASE WHEN event_type <> 'view' THEN ts END AS published FROM events))""")
def _(s, d):
    published = F.when(F.col("event_type") != "view", F.col("ts"))
    fresh = T.freshness(published, ts(NOW), 14 * 24 * 60)
    return table(s, d, "events").select("event_id", fresh.alias("f")).select("event_id", "f.fresh", "f.reason")


@query("source_report", """
WITH p AS (SELECT user_id, count(*) AS received, count_if(event_type = 'purchase') AS accepted, count_if(event_type = 'view') AS duplicates
  FROM events GROUP BY 1),
q AS (SELECT c_custkey AS user_id, 50 + c_custkey % 50 AS quality_score, coalesce(received, 0) AS received, coalesce(accepted, 0) AS accepted,
  coalesce(duplicates, 0) AS duplicates FROM customer LEFT JOIN p ON p.user_id = c_custkey)
SELECT *, received - accepted - duplicates AS rejected, accepted / greatest(received, 1) AS useful_ratio,
  CASE WHEN received < 25 THEN 'KEEP' WHEN quality_score < 70 OR accepted / greatest(received, 1) < 0.05 THEN 'REMOVE'
  WHEN quality_score < 85 OR accepted / greatest(received, 1) < 0.15 THEN 'REVIEW' ELSE 'KEEP' END AS suggestion FROM q""")
def _(s, d):
    sources = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), (50 + F.col("c_custkey") % 50).alias("quality_score"))
    return reports.source_report(sources, table(s, d, "events"), "user_id", "event_type", "purchase", "view")


@query("pipeline_rates", """
SELECT count_if(s = 'PUBLISHED') AS alerts_sent, count_if(s = 'DUPLICATE') / greatest(count(*), 1) AS duplicate_rate,
  count_if(s IN ('FILTERED', 'BELOW_THRESHOLD')) / greatest(count(*), 1) AS rejection_rate
FROM (SELECT CASE event_type WHEN 'purchase' THEN 'PUBLISHED' WHEN 'view' THEN 'DUPLICATE' WHEN 'click' THEN 'FILTERED' ELSE 'BELOW_THRESHOLD' END AS s FROM events)""")
def _(s, d):
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "PUBLISHED").when(kind == "view", "DUPLICATE").when(kind == "click", "FILTERED").otherwise("BELOW_THRESHOLD")
    return reports.pipeline_rates(table(s, d, "events").withColumn("status", status), "status")


@query("distinct_org_corroboration", """
SELECT l_partkey, count(DISTINCT coalesce(CAST(CASE WHEN s_nationkey % 5 > 0 THEN s_nationkey END AS VARCHAR), 's' || l_suppkey)) AS confirmed_by
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def _(s, d):
    df = table(s, d, "lineitem").join(table(s, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    df = df.select("l_partkey", F.when(F.col("s_nationkey") % 5 > 0, F.col("s_nationkey")).alias("org"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"))
    return reports.corroboration(df, "l_partkey", "org", "src")


@query("contributor_merge", """
WITH r AS (SELECT l_partkey, l_suppkey, l_shipdate, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag, CASE WHEN l_linenumber > 2 THEN l_quantity END AS quantity FROM lineitem)
SELECT l_partkey, l_suppkey, min(l_shipdate) AS first_seen_at, arg_min(flag, {'t': l_shipdate, 'v': flag}) FILTER (flag IS NOT NULL) AS flag,
  arg_min(quantity, {'t': l_shipdate, 'v': quantity}) FILTER (quantity IS NOT NULL) AS quantity FROM r GROUP BY 1, 2""")
def _(s, d):
    flag, quantity = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), F.when(F.col("l_linenumber") > 2, F.col("l_quantity"))
    df = table(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", flag.alias("flag"), quantity.alias("quantity"))
    return reports.contributors(df, "l_partkey", "l_suppkey", "l_shipdate", ["flag", "quantity"])


@query("newest_n_per_key", """
SELECT event_id, user_id, CAST(rank AS INTEGER) AS rank FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events)
WHERE rank <= 5""")
def _(s, d):
    return reports.newest_per_key(table(s, d, "events"), "user_id", "ts", 5, "event_id").select("event_id", "user_id", "rank")


@query("newest_posts", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 200")
def _(s, d):
    return reports.newest(table(s, d, "events").select("event_id", "ts"), "ts", 200, "event_id")


@query("best_member", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber DESC, l_partkey DESC) AS n
FROM lineitem) WHERE n = 1""")
def _(s, d):
    df = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.struct("l_linenumber", "l_partkey").alias("tie"))
    return reports.best_by(df, "l_orderkey", "l_extendedprice", "tie").drop("tie")


@query("peak_running", """
SELECT event_id, max(value) OVER w AS peak, arg_max(event_type, {'v': value, 't': -epoch_us(ts), 'i': -event_id}) OVER w AS peak_label
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def _(s, d):
    df = reports.running_peak(table(s, d, "events"), "user_id", "ts", "value", "event_type", "event_id")
    return df.select("event_id", "peak", "peak_label")


@query("failure_islands", """
SELECT event_id, CAST(sum(bad) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS consecutive_failures
FROM (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bad,
  sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)""")
def _(s, d):
    df = reports.failure_runs(table(s, d, "events"), "user_id", "ts", F.col("event_type") != "error", "event_id")
    return df.select("event_id", "consecutive_failures")


_HEALTH = f"""
WITH l AS (SELECT user_id, max(ts) FILTER (event_type <> 'error') AS last_success_at, max(ts) FILTER (event_type IN ('click', 'purchase')) AS last_item_at FROM events GROUP BY 1),
f AS (SELECT user_id, count(*) AS n FROM events JOIN l USING (user_id) WHERE event_type = 'error' AND (last_success_at IS NULL OR ts > last_success_at) GROUP BY 1),
h AS (SELECT l.*, coalesce(n, 0) AS consecutive_failures, epoch_us(TIMESTAMP '{NOW}') // 1000 - epoch_us(last_item_at) // 1000 AS since FROM l LEFT JOIN f USING (user_id)),
e AS (SELECT user_id, consecutive_failures, CASE WHEN consecutive_failures >= 3 THEN 'DISCONNECTED' WHEN consecutive_failures > 0 THEN 'ERROR'
  WHEN last_success_at IS NULL THEN 'ACTIVE' WHEN since IS NULL OR since > 3 * 21600000 THEN 'STALE' WHEN since > 21600000 THEN 'DELAYED' ELSE 'ACTIVE' END AS state FROM h)
"""


def _health(s, d):
    kind = F.col("event_type")
    items = F.when(kind.isin("click", "purchase"), 1).otherwise(0)
    return health.evaluate(table(s, d, "events"), "user_id", "ts", kind != "error", items, ts(NOW), F.lit(21_600_000))


@query("feed_health", _HEALTH + "SELECT * FROM e")
def _(s, d):
    return _health(s, d).select("user_id", "consecutive_failures", "state")


@query("feed_health_counts", _HEALTH + "SELECT state, count(*) AS n FROM e WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1")
def _(s, d):
    enabled = table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    return reports.counts_by(_health(s, d).join(enabled, "user_id", "left_semi"), "state")


@query("feed_backoff", """
SELECT user_id, least(60.0, CASE WHEN n < 3 THEN 0.0 ELSE 5 * power(2.0, n - 3) END) AS minutes FROM (SELECT user_id, count_if(event_type = 'error') % 9 AS n FROM events GROUP BY 1)""")
def _(s, d):
    df = table(s, d, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") % 9).alias("n"))
    return df.select("user_id", health.backoff_minutes(F.col("n")).alias("minutes"))


@query("credit_budget", """
SELECT event_id, round(spent, 4) AS spent, spent <= 2000 AS granted FROM (SELECT event_id, sum(value) OVER (PARTITION BY event_type, CAST(ts AS DATE)
  ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events)""")
def _(s, d):
    df = table(s, d, "events").withColumn("day", F.to_date("ts"))
    df = reports.within_budget(df, ["event_type", "day"], ["ts", "event_id"], "value", 2000)
    return df.select("event_id", r4(F.col("spent")).alias("spent"), "granted")


@query("interval_lookback_semi", """
SELECT DISTINCT a.event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.event_id <> a.event_id
  AND (b.ts < a.ts OR b.ts = a.ts AND b.event_id < a.event_id) AND epoch_us(b.ts) // 1000 >= epoch_us(a.ts) // 1000 - 90 * 60000""")
def _(s, d):
    df = table(s, d, "events").select(
        F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.concat_ws("|", "user_id", "event_type").alias("k")
    )
    return dedupe.earlier_within(df, F.col("k"), 90 * 60_000).select(F.col("id").alias("event_id"))


@query("cluster_sessions", """
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 14400000000 THEN 1 ELSE 0 END AS fresh
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY 1, 2""")
def _(s, d):
    return reports.sessions(table(s, d, "events"), "user_id", "ts", 240, "event_id")


@query("anti_orphans", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _(s, d):
    return merge.orphans(table(s, d, "orders").select("o_orderkey"), table(s, d, "lineitem"), "o_orderkey", "l_orderkey")


@query("landing_first", """
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts) AS n FROM events) WHERE n = 1""")
def _(s, d):
    df = table(s, d, "events").withColumn("day", F.to_date("ts"))
    return dedupe.land(df, ("user_id", "event_type", "day"), "ts").select("user_id", "event_type", "event_id")


@query("cold_start_priming", """
SELECT event_id, user_id IN (SELECT user_id FROM events WHERE ts < '2024-01-02') AS publish FROM events WHERE ts >= '2024-01-02' AND ts < '2024-01-03'""")
def _(s, d):
    df = table(s, d, "events")
    batch = df.where((F.col("ts") >= ts("2024-01-02")) & (F.col("ts") < ts("2024-01-03")))
    return merge.prime(batch, df.where(F.col("ts") < ts("2024-01-02")), "user_id").select("event_id", "publish")


@query("event_upsert", """
SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(hash, event_id) FILTER (hash <> '') AS hash, max(event_id) AS event_id
FROM (SELECT user_id, event_type, event_id, CASE WHEN event_type = 'view' THEN '' ELSE 'h' || event_id END AS hash FROM events) GROUP BY 1""")
def _(s, d):
    hash_ = F.when(F.col("event_type") == "view", "").otherwise(F.concat(F.lit("h"), F.col("event_id")))
    df = table(s, d, "events").select("user_id", "event_type", hash_.alias("hash"), "event_id").withColumn("version", F.col("event_id"))
    half = ts("2024-01-15")
    dated = table(s, d, "events").select("event_id", "ts")
    df = df.join(dated, "event_id")
    old, new = df.where(F.col("ts") < half).drop("ts"), df.where(F.col("ts") >= half).drop("ts")
    return merge.upsert(old, new, ["user_id"], "version", ["hash"]).drop("version")


@query("sticky_times", """
SELECT user_id, arg_min(p, ts) FILTER (p IS NOT NULL) AS first_purchase, arg_max(event_type, ts) AS last_type
FROM (SELECT user_id, ts, event_type, CASE WHEN event_type = 'purchase' THEN event_id END AS p FROM events) GROUP BY 1""")
def _(s, d):
    df = table(s, d, "events").withColumn("first_purchase", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    df = df.withColumn("last_type", F.col("event_type"))
    return merge.sticky_first(df, ["user_id"], "ts", ["first_purchase"], ["last_type"])


@query("source_sync", """
SELECT coalesce(c.c_custkey, l.c_custkey) AS id, c.c_custkey IS NOT NULL AS enabled, coalesce(l.created, c.created) AS created_at
FROM (SELECT c_custkey, 'old' AS created FROM customer WHERE c_custkey % 3 <> 0) l FULL OUTER JOIN (SELECT c_custkey, 'new' AS created FROM customer WHERE c_custkey % 3 <> 1) c USING (c_custkey)""")
def _(s, d):
    ids = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(True).alias("enabled"))
    live = ids.where("id % 3 <> 0").withColumn("created_at", F.lit("old"))
    return merge.sync_sources(live, ids.where("id % 3 <> 1").withColumn("created_at", F.lit("new")))


@query("retention", f"SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY ORDER BY ts DESC LIMIT 3000")
def _(s, d):
    return merge.retain(table(s, d, "events").select("event_id", "ts"), "ts", ts(NOW), 14, 3000).select("event_id", "ts")


@query("lead_time_cross", """
SELECT o_orderkey AS id, CAST(max(m) AS INTEGER) AS lead_minutes FROM orders, (VALUES (1440), (60), (15)) l(m)
WHERE epoch_ms(o_orderdate) >= epoch_ms(TIMESTAMP '1997-06-01 23:00:00') AND abs((epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1997-06-01 23:00:00')) / 60000.0 - m) <= 3
  AND o_orderkey % 5 > 0 GROUP BY 1""")
def _(s, d):
    events = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("cpi").alias("name"), F.col("o_orderdate").alias("scheduled_at"))
    fired = events.where("id % 5 = 0").select(F.explode(F.array(*(F.concat_ws(":", "id", F.lit(m)) for m, _ in calendar.LEADS))).alias("key"))
    return calendar.due_reminders(events, fired, ts("1997-06-01 23:00:00")).select("id", "lead_minutes")


_TOKENS, _STOP = Q.tokens("text"), Q.STOP


@query("token_counts", f"SELECT doc_id, len({_TOKENS}) AS n_tokens, len(list_filter({_TOKENS}, lambda t: length(t) > 1 AND t NOT IN ({_STOP}))) AS n_significant FROM documents")
def _(s, d):
    tokens = X.tokenize(F.coalesce("text", F.lit("")))
    df = table(s, d, "documents").select("doc_id", tokens.alias("t"))
    return df.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(X.significant(F.col("t"))).cast("long").alias("n_significant"))


@query("fingerprint_groups", f"""
SELECT fingerprint, count(*) AS n, min(doc_id) AS first_key FROM (SELECT doc_id, substr(sha256(array_to_string(list_sort(list_distinct(
  list_filter({_TOKENS}, lambda t: length(t) > 1 AND t NOT IN ({_STOP})))), ' ')), 1, 32) AS fingerprint FROM documents) GROUP BY 1 HAVING count(*) > 1""")
def _(s, d):
    return dedupe.content_groups(table(s, d, "documents").fillna("", ["text"]), "doc_id", "text")


@query("jaccard_pairs", f"""
WITH w AS (SELECT doc_id, list_sort(list_distinct({Q.significant(_TOKENS)})) AS words FROM documents),
g AS (SELECT words, min(doc_id) AS key, count(*) AS n FROM w WHERE len(words) > 0 GROUP BY words),
e AS (SELECT key, len(words) AS size, n, unnest(words) AS word FROM g),
p AS (SELECT a.key, b.key AS other, count(*) / (any_value(a.size) + any_value(b.size) - count(*)) AS similarity, any_value(a.n) AS n_key, any_value(b.n) AS n_other
  FROM e a JOIN e b USING (word) WHERE a.key < b.key GROUP BY 1, 2)
SELECT key, other, round(similarity, 6) AS similarity, n_key, n_other FROM p WHERE similarity >= 0.5""")
def _(s, d):
    df = dedupe.similar_pairs(table(s, d, "documents"), "doc_id", text_words(F.col("text")), 0.5)
    return df.withColumn("similarity", F.round("similarity", 6))


@query("simhash_near_dups", f"""
WITH w AS (SELECT doc_id, {_TOKENS} AS t FROM documents), {Q.simhashes("s", "w", "doc_id", "t")},
g AS (SELECT h, min(doc_id) AS key, count(*) AS n FROM s WHERE h <> 0 GROUP BY h)
SELECT a.key, b.key AS other, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS bits, a.n AS n_key, b.n AS n_other
FROM g a JOIN g b ON a.key < b.key WHERE bit_count(xor(a.h, b.h)) <= {dedupe.MOST_BITS}""")
def _(s, d):
    df = table(s, d, "documents").select("doc_id", text_simhash64(F.col("text")).alias("h"))
    return dedupe.near_hashes(df, "doc_id", "h")


@query("url_canonical_groups", r"""
WITH u AS (SELECT page_id, trim(url) AS url FROM pages),
p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)', 1)), '^www\.', '') AS host,
  regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(string_split(x, '=')[1],
    '(?i)^(?:utm_[a-z]+|fbclid|gclid|mc_cid|mc_eid|igshid|ref|source|s|t)$'))) AS q FROM u)
SELECT canonical, count(*) AS n, min(page_id) AS first_key FROM (SELECT page_id, CASE WHEN host = '' THEN regexp_replace(lower(url), '/+$', '')
  ELSE host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical FROM p) GROUP BY 1""")
def _(s, d):
    df = table(s, d, "pages").select("page_id", canonical_url(F.col("url")).alias("canonical"))
    return df.groupBy("canonical").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_key"))


@query("post_links", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN array_to_string(list_sort(['x:' || p_partkey, 'x:' || (p_partkey + 1000)]), ',') WHEN 1 THEN 'x:' || p_partkey ELSE '' END AS ids FROM part""")
def _(s, d):
    size, key = F.col("p_size") % 4, F.col("p_partkey")
    both = F.format_string("https://x.com/a/status/%d, https://www.twitter.com/b_c/statuses/%d?s=1 and HTTPS://fxtwitter.com/a/status/%d", key, key + 1000, key)
    text = F.when(size == 0, both).when(size == 1, F.format_string("(http://mobile.vxtwitter.com/a/status/%d)", key)).when(size == 2, F.format_string("https://x.com/a/likes/%d", key))
    return table(s, d, "part").select("p_partkey", F.array_join(F.array_sort(F.coalesce(post_ids(text), F.array().cast("array<string>"))), ",").alias("ids"))


@query("html_strip", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '<[^>]*>', ' ', 'g'), '(?i)&(?:amp|#38);', '&', 'g'), '(?i)&(?:lt|#60);', '<', 'g'), '(?i)&(?:gt|#62);', '>', 'g'), '(?i)&(?:quot|#34);', '"', 'g'),
  '(?i)&(?:apos|#39);', '''', 'g'), '(?i)&nbsp;', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def _(s, d):
    return table(s, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@query("figures_extract", r"""
WITH f AS (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '-?\d[\d,]*\.?\d*'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda x: x IS NOT NULL)) AS n FROM documents)
SELECT doc_id, len(n) AS n_figures, round(list_sum(list_transform(n, lambda x: ln(1 + abs(x)))), 4) AS logs, list_min(n) AS least, list_max(n) AS greatest FROM f""")
def _(s, d):
    df = table(s, d, "documents").select("doc_id", X.figures_in(F.coalesce("text", F.lit(""))).alias("n"))
    logs = F.aggregate("n", F.lit(0.0), lambda a, x: a + F.log(1 + F.abs(x)))
    return df.select("doc_id", F.size("n").cast("long").alias("n_figures"), F.when(F.size("n") > 0, r4(logs)).alias("logs"), F.array_min("n").alias("least"), F.array_max("n").alias("greatest"))


_FIGURES = "CPI up %d.5%% vs 25 bps; revenue of $%d.25bn at %dx, a half point"


@query("figure_kinds", """
WITH p AS (SELECT p_partkey, p_size FROM part)
SELECT p_partkey, 'BPS' AS kind, '25 bps' AS raw, 25.0::DOUBLE AS value, 'bps' AS unit, 'cpi' AS label FROM p
UNION ALL SELECT p_partkey, 'BPS', 'half point', 50.0, 'bps', NULL FROM p
UNION ALL SELECT p_partkey, 'PERCENT', p_size || '.5%', p_size + 0.5, '%', 'cpi' FROM p
UNION ALL SELECT p_partkey, 'CURRENCY', '$' || p_size || '.25bn', (p_size + 0.25) * 1e9, 'USD', 'revenue' FROM p
UNION ALL SELECT p_partkey, 'MULTIPLE', p_size % 9 || 'x', p_size % 9, 'x', 'revenue' FROM p""")
def _(s, d):
    text = F.format_string(_FIGURES, "p_size", "p_size", F.col("p_size") % 9)
    df = table(s, d, "part").select("p_partkey", F.explode(extract_figures(text)).alias("f"))
    return df.select("p_partkey", "f.kind", "f.raw", "f.value", "f.unit", "f.label")


def _terms(terms: str) -> str:
    return f"regexp_matches(text, '(?i)(^|[^A-Za-z0-9])(?:{terms})($|[^A-Za-z0-9])')"


def _n(terms: tuple[str, ...]) -> str:
    return " + ".join(f"CAST({_terms(t)} AS INTEGER)" for t in terms) if terms else "0"


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _category_sql() -> str:
    parts = []
    for c in SAMPLE.categories:
        body = f"(len(list_intersect(t, {_list(c.keywords)})) * 1.0" + (f" + 3.0 * ({_n(c.phrases)})" if c.phrases else "")
        body += (" + 2.0" if c.requires else "") + f") * {c.weight}"
        if c.requires:
            body = f"CASE WHEN {_terms('|'.join(c.requires))} THEN {body} ELSE 0.0 END"
        parts.append(f"CAST({body} AS DOUBLE) AS \"{c.name}\"")
    return f"SELECT doc_id, {', '.join(parts)} FROM (SELECT doc_id, coalesce(text, '') AS text, {_TOKENS} AS t FROM documents)"


@query("term_category_score", _category_sql())
def _(s, d):
    text = F.coalesce("text", F.lit(""))
    df = table(s, d, "documents").select("doc_id", text.alias("text"), X.tokenize(text).alias("t"))
    df, found = with_terms(df, "text", classify.category_terms(SAMPLE.categories))
    return df.select("doc_id", *(classify.category_score(found, F.col("t"), c).alias(c.name) for c in SAMPLE.categories))


def _verdict_sql() -> str:
    rank = {c: i for i, c in enumerate(classify.PRECEDENCE)}
    scores = ", ".join(f"{{'score': \"{c.name}\", 'rank': {rank.get(c.name, 99)}, 'name': '{c.name}'}}" for c in SAMPLE.categories)
    case = " ".join(f"WHEN name = '{c.name}' AND {_terms('|'.join(terms))} THEN '{sub}'" for c in SAMPLE.categories for sub, terms in c.subcategories.items())
    return f"""
WITH c AS ({_category_sql()}), e AS (SELECT doc_id, unnest([{scores}], recursive := true) FROM c),
t AS (SELECT doc_id, max(score) AS top FROM e WHERE score > 0 GROUP BY 1),
w AS (SELECT doc_id, score, name, top, row_number() OVER (PARTITION BY doc_id ORDER BY rank, score) AS place FROM e JOIN t USING (doc_id) WHERE score > 0 AND score >= top * {classify.NEAR_TIE}),
v AS (SELECT w.*, coalesce(text, '') AS text FROM w JOIN documents USING (doc_id) WHERE place = 1),
g AS (SELECT * FROM v WHERE top >= {classify.WEAK} AND (top >= {classify.STRONG} OR regexp_matches(text, '\\d')))
SELECT d.doc_id, name AS category, CASE {case.replace('(text,', '(g.text,')} END AS subcategory, CASE WHEN name IS NOT NULL THEN least(1.0, score / 12) END * CASE WHEN top < {classify.STRONG} THEN 0.5 ELSE 1.0 END AS confidence
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id"""


@query("category_verdicts", _verdict_sql())
def _(s, d):
    text = F.coalesce("text", F.lit(""))
    df = table(s, d, "documents").select("doc_id", text.alias("text"), X.tokenize(text).alias("t"))
    df, found = with_terms(df, "text", classify.category_terms(SAMPLE.categories))
    verdict = classify.classify_category(found, F.col("t"), SAMPLE.categories, F.col("text").rlike("\\d"))
    return df.select("doc_id", verdict.alias("v")).select("doc_id", "v.category", "v.subcategory", "v.confidence")


def _ticker_sql() -> str:
    context = ", ".join(f"'{w}'" for w in extract.CONTEXT)
    parts = []
    for s in SAMPLE.securities:
        names = "|".join(re.escape(f) for f in extract.name_forms(s))
        alone = rf"(^|[^A-Za-z0-9\-/''’.$]){s.ticker}($|[^A-Za-z0-9\-/''’.]|\.(\s|$))"
        bare = {"safe": f"WHEN regexp_matches(text, '{alone}') THEN {extract.SAFE}", "blocked": ""}.get(
            s.ambiguity, f"WHEN about AND regexp_matches(text, '{alone}') THEN CASE WHEN caps THEN {extract.AMBIGUOUS_CAPS} ELSE {extract.AMBIGUOUS} END"
        )
        named = f"WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9])(?:{names})($|[^A-Za-z0-9])') THEN {extract.NAME}" if names else ""
        parts.append(rf"{{'ticker': '{s.ticker}', 'confidence': CAST(CASE WHEN regexp_matches(text, '(?i)\${s.ticker}\b') THEN {extract.CASHTAG} {named} {bare} END AS DOUBLE)}}")
    return f"""
WITH l AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') AS letters FROM documents),
x AS (SELECT *, length(letters) >= 3 AND letters = upper(letters) AS caps, list_has_any(regexp_extract_all(lower(text), '[a-z]+'), [{context}]) AS about FROM l)
SELECT doc_id, ticker, confidence FROM (SELECT doc_id, unnest([{", ".join(parts)}], recursive := true) FROM x) WHERE confidence IS NOT NULL"""


@query("ticker_mentions", _ticker_sql())
def _(s, d):
    df = table(s, d, "documents").select("doc_id", F.explode(extract.extract_tickers(F.col("text"), SAMPLE.securities)).alias("t"))
    return df.select("doc_id", "t.ticker", "t.confidence")


def _entity_sql() -> str:
    def fits(form: str) -> str:
        case = "" if re.fullmatch("[A-Z]{2,5}", form) else "(?i)"
        return f"regexp_matches(text, '{case}(^|[^A-Za-z0-9]){re.escape(form)}($|[^A-Za-z0-9])')"

    names = {c: {c, *forms} for kind in (SAMPLE.countries, SAMPLE.organizations, SAMPLE.people, SAMPLE.commodities) for c, forms in kind.items()}
    parts = ", ".join(f"CASE WHEN {' OR '.join(fits(f) for f in sorted(forms))} THEN '{c}' END" for c, forms in names.items())
    return f"SELECT doc_id, array_to_string(list_sort(list_filter([{parts}], lambda x: x IS NOT NULL)), ',') AS names FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


@query("entity_mentions", _entity_sql())
def _(s, d):
    kinds = (SAMPLE.countries, SAMPLE.organizations, SAMPLE.people, SAMPLE.commodities)
    found = F.concat(*(extract.extract_entities(F.col("text"), dict(k)) for k in kinds))
    return table(s, d, "documents").select("doc_id", F.array_join(F.array_sort(found), ",").alias("names"))


def _noise_sql() -> str:
    among = lambda words: f"len(list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in words)})))"
    case = f"CASE WHEN len(t) >= 6 AND {among(classify.FOREIGN)} >= 2 AND {among(classify.ENGLISH)} = 0 THEN 'NOISE_FOREIGN_LANGUAGE'"
    for cls, reason in classify.NOISE_REASONS.items():
        terms = SAMPLE.noise.get(cls, ())
        if terms:
            phrases, words = tuple(t for t in terms if " " in t), tuple(t for t in terms if " " not in t)
            case += f" WHEN 2 * ({_n(phrases)}) + ({_n(words)}) >= 2 THEN '{reason}'"
    return f"SELECT doc_id, {case} END AS reason FROM (SELECT doc_id, coalesce(text, '') AS text, {_TOKENS} AS t FROM documents)"


@query("noise_ordered_reason", _noise_sql())
def _(s, d):
    text = F.coalesce("text", F.lit(""))
    df = table(s, d, "documents").select("doc_id", text.alias("text"), X.tokenize(text).alias("t"))
    df, found = with_terms(df, "text", (), classify.noise_terms(SAMPLE.noise))
    return df.select("doc_id", classify.classify_noise(found, F.col("t"), SAMPLE.noise)["reason"].alias("reason"))


@query("factuality", f"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS text, {_TOKENS} AS t FROM documents),
f AS (SELECT doc_id, CASE WHEN len(list_intersect(t, {_list(SAMPLE.verbs)})) > 0 THEN 1.0 ELSE 0.0 END + 2.0 * ({_n(SAMPLE.factual)})
    + CASE WHEN regexp_matches(text, '^\\s*[A-Z][A-Z0-9.\\s]{{1,24}}:\\s') THEN 2.0 ELSE 0.0 END + CASE WHEN regexp_matches(text, '["“][^"”]{{10,}}["”]') THEN 1.5 ELSE 0.0 END
    + CASE WHEN regexp_matches(text, '\\d') THEN 1.5 ELSE 0.0 END AS f,
  2.0 * ({_n(SAMPLE.commentary)}) + CASE WHEN regexp_matches(text, '\\?\\s*$') OR regexp_matches(text, '(?i)^\\s*(?:why|how|imagine|remember)\\b') THEN 1.5 ELSE 0.0 END
    + CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z])(?:you|your|you''re|yours)($|[^A-Za-z])') THEN 1.0 ELSE 0.0 END AS c FROM b)
SELECT doc_id, CASE WHEN f >= c THEN 'FACTUAL_NEWS' ELSE 'COMMENTARY' END AS verdict,
  round(CASE WHEN f + c = 0 THEN 0.5 ELSE least(0.95, 0.55 + abs(f - c) / (f + c) * 0.4) END, 6) AS confidence FROM f""")
def _(s, d):
    text = F.coalesce("text", F.lit(""))
    df = table(s, d, "documents").select("doc_id", text.alias("text"), X.tokenize(text).alias("t"))
    df, found = with_terms(df, "text", (), [*SAMPLE.factual, *SAMPLE.commentary])
    v = classify.classify_factuality(found, F.col("t"), F.col("text").rlike("\\d"), SAMPLE.verbs, SAMPLE.factual, SAMPLE.commentary)
    return df.select("doc_id", v.alias("v")).select("doc_id", "v.verdict", F.round("v.confidence", 6).alias("confidence"))


@query("filing_materiality", """
SELECT p_partkey, CASE level WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'IGNORE' END AS materiality
FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_type = 'ECONOMY' THEN 4 ELSE greatest(CASE p_size % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 1 END,
  CASE WHEN p_size % 2 = 0 THEN 3 ELSE 1 END) END AS level FROM part)""")
def _(s, d):
    size = F.col("p_size") % 4
    form = F.when(size == 0, "8-K").when(size == 1, "10-K").when(size == 2, "SC 13D").otherwise("4")
    items = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("5.02"))).otherwise(F.array(F.lit("9.01")))
    title = F.when(F.col("p_type") == "ECONOMY", "CEO resigns").otherwise("report")
    return table(s, d, "part").select("p_partkey", classify.filing_materiality(form, items, title).alias("materiality"))


@query("score_weighted_total", """
WITH c AS (SELECT p_partkey, least(100, greatest(0, p_retailprice % 101 - (p_size % 41) * 0.5)) AS q, least(100, 30 + least(40, (p_size % 3) * 20.0) + least(15, (p_size % 4) * 7.0)) AS m,
  100 - least(70, (p_size % 5) * 18.0) - least(20, p_size * 0.25) + 0.5 * 30 AS n, 60 + (p_retailprice % 101) * 0.25 AS cr FROM part),
t AS (SELECT p_partkey, least(100, greatest(0, q * 0.2 + 70 * 0.25 + least(100, greatest(0, n)) * 0.15 + m * 0.2 + 80 * 0.1
  + least(100, greatest(0, cr + 0.9 * 12 + 10.0 - 0.1 * 5)) * 0.1)) AS total FROM c)
SELECT p_partkey, round(total, 6) AS total, CASE WHEN total >= 90 THEN 'CRITICAL' WHEN total >= 75 THEN 'HIGH' WHEN total >= 60 THEN 'MODERATE' WHEN total >= 40 THEN 'LOW' ELSE 'IGNORE' END AS band FROM t""")
def _(s, d):
    size, quality = F.col("p_size"), F.col("p_retailprice") % 101
    fact = F.lit("FACTUAL_NEWS")
    parts = {
        "source_quality": score.source_quality(quality, size % 41),
        "market_relevance": score.market_relevance(F.lit("EQUITY"), {"EQUITY": 70}),
        "novelty": score.novelty(size % 5, size, F.lit(0.5), F.lit(False)),
        "magnitude": score.magnitude(size % 3, size % 4),
        "asset_exposure": score.asset_exposure(F.lit(None).cast("double"), F.lit("FED"), F.lit(False), F.lit(False)),
        "credibility": score.credibility(F.lit(False), quality, fact, F.lit(0.9), F.lit(2), F.lit(0.1)),
    }
    df = table(s, d, "part").select("p_partkey", score.total_score(parts).alias("total"))
    return df.select("p_partkey", F.round("total", 6).alias("total"), score.band(F.col("total")).alias("band"))


@query("route_channels", """
SELECT event_id, array_to_string(['news'] || CASE WHEN moving AND (macro OR NOT name) THEN ['spx'] ELSE [] END || CASE WHEN moving AND (name OR NOT macro) THEN ['tradingFloor'] ELSE [] END, ',') AS channels
FROM (SELECT event_id, value > 20 AS moving, event_type = 'view' OR user_id % 7 = 0 AS macro, user_id % 2 = 1 OR event_type = 'purchase' OR user_id % 7 = 1 AS name FROM events)""")
def _(s, d):
    kind, user = F.col("event_type"), F.col("user_id")
    relevance = F.when(user % 7 == 0, "broad").when(user % 7 == 1, "sector").otherwise("none")
    category = F.when(kind == "purchase", "EARNINGS").otherwise("MARKET")
    channels = score.route(F.col("value") > 20, kind == "view", relevance, category, F.when(user % 2 == 1, 1).otherwise(0))
    return table(s, d, "events").select("event_id", F.array_join(channels, ",").alias("channels"))


@query("claim_shards", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) % 4 AS INTEGER) AS worker FROM (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 500)")
def _(s, d):
    due = table(s, d, "orders").where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(500)
    place = F.row_number().over(Window.orderBy("o_orderdate", "o_orderkey")) - 1
    return due.select("o_orderkey", (place % 4).cast("int").alias("worker"))


@query("event_slugs", r"""
SELECT p_partkey, substr(regexp_replace(lower(p_brand) || '-' || array_to_string(list_slice(list_filter(regexp_split_to_array(regexp_replace(lower(p_name), '[^a-z0-9\s-]', ' ', 'g'), '\s+'),
  lambda w: length(w) > 2), 1, 4), '-') || '-2024-01-01', '-+', '-', 'g'), 1, 90) AS slug FROM part""")
def _(s, d):
    slug = cluster.event_slug(F.col("p_name"), F.array("p_brand"), F.lit("2024-01-01").cast("timestamp"))
    return table(s, d, "part").select("p_partkey", slug.alias("slug"))


@query("wire_headlines", f"""
WITH {Q.headlines()},
l AS (SELECT *, length(regexp_replace(clean, '\\P{{L}}', '', 'g')) AS letters, length(regexp_replace(clean, '\\P{{Latin}}', '', 'g')) AS latin FROM posts)
SELECT id AS doc_id, headline, CAST(length(body) AS INTEGER) AS body_chars,
  CASE WHEN letters - latin > 0.3 * greatest(letters, 1) THEN 'non-latin' ELSE 'en' END AS language, {Q.fingerprint(Q.tokens("clean"))} AS fingerprint FROM l""")
def _(s, d):
    df = P.normalize(table(s, d, "documents"))
    return df.select("doc_id", "headline", F.length("body").alias("body_chars"), "language", "fingerprint")


_MARKED = "regexp_replace({0}, '([\\\\*_`~|>])', '\\\\\\1', 'g')"


def _short(text: str, limit: int) -> str:
    head = f"substr({text}, 1, {limit})"
    space = f"length({head}) - strpos(reverse({head}), ' ')"
    cut = f"CASE WHEN strpos({head}, ' ') > 0 AND {space} > {limit} * 0.6 THEN substr({head}, 1, {space}) ELSE {head} END"
    return f"CASE WHEN length({text}) <= {limit} THEN {text} ELSE regexp_replace({cut}, '[\\s.,;:—–-]+$', '') || '...' END"


@query("rendered_alerts", f"""
WITH {Q.headlines()},
o AS (SELECT id, {Q.one_space("headline")} AS h, {Q.one_space("body")} AS b, headline FROM posts),
r AS (SELECT id, {Q.upper(_short("h", 60))} AS h, CASE WHEN len(list_filter({Q.tokens("b")}, lambda x: NOT list_contains({Q.tokens("headline")}, x))) = 0 THEN '' ELSE {_short("b", 320)} END AS b FROM o),
a AS (SELECT id, '**NEWS**' || chr(10) || chr(10) || '**' || {_MARKED.format("h")} || '**' || chr(10) || chr(10) || '5:14 PM · May 24, 2024'
  || CASE WHEN b <> '' THEN chr(10) || chr(10) || {_MARKED.format("b")} ELSE '' END AS alert FROM r)
SELECT id AS doc_id, alert, regexp_matches(alert, '(^|\\s)@[A-Za-z0-9_]{{2,}}') OR regexp_matches(alert, '(?i)https?://')
  OR regexp_matches(alert, '(?m)^(?:SOURCE|SCORE|CATEGORY|BAND|CONFIDENCE)\\s*:') AS blocked FROM a""")
def _(s, d):
    df = P.normalize(table(s, d, "documents"))
    when = T.alert_time(F.lit("2024-05-24 21:14:00").cast("timestamp"))
    # Steps of their own, so that each is computed once.
    df = df.select("doc_id", render.alert_headline(F.col("headline")).alias("head"), render.alert_body(F.col("headline"), F.col("body")).alias("body"))
    df = df.select("doc_id", render.render_alert(F.lit("NEWS"), F.col("head"), when, F.col("body")).alias("alert"))
    return df.withColumn("blocked", render.leaks_metadata(F.col("alert")))


_NEGATIONS = ", ".join(f"'{w}'" for w in X.NEGATIONS)


@query("duplicate_posts", f"""
WITH {Q.headlines()},
t AS (SELECT id, text, headline, doc_id // 2 * 60000 AS ms, CASE WHEN doc_id % 10 = 3 THEN doc_id // 20 % 50 END AS link,
    {Q.equivalent("CASE WHEN headline = '' THEN coalesce(text, '') ELSE headline END")} AS equivalent
  FROM posts JOIN documents ON doc_id = id),
p AS (SELECT *, {Q.tokens("text")} AS tokens, {Q.tokens("equivalent")} AS h_tokens, row_number() OVER (ORDER BY ms, id) AS place FROM t),
{Q.simhashes("hs", "p", "id", "h_tokens")}, {Q.simhashes("ts", "p", "id", "tokens")},
r AS (SELECT p.id, ms, link, place, coalesce(hs.h, 0) AS hh, coalesce(ts.h, 0) AS th, {Q.fingerprint("tokens")} AS fingerprint,
    list_distinct({Q.significant("h_tokens")}) AS words, list_filter({Q.significant("tokens")}, lambda w: length(w) >= 3) AS entities,
    list_filter({Q.significant(Q.tokens("headline"))}, lambda w: length(w) >= 3) AS known_by,
    list_filter(list_transform(regexp_extract_all(headline, '-?\\d[\\d,]*\\.?\\d*'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda x: x IS NOT NULL) AS figures,
    list_has_any(h_tokens, [{_NEGATIONS}]) AS negated
  FROM p LEFT JOIN hs ON hs.id = p.id LEFT JOIN ts ON ts.id = p.id),
j AS (SELECT a.id, b.id AS other, b.place AS newer, a.link = b.link AS same_link, a.fingerprint = b.fingerprint AS same_text, a.negated <> b.negated AS turned,
    len(a.figures) > 0 AND len(b.figures) > 0 AND NOT list_has_any(a.figures, b.figures) AS parted, list_has_any(a.entities, b.known_by) AS known,
    len(list_intersect(a.words, b.words)) AS c, len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)) AS u,
    1 - bit_count(xor(a.hh, b.hh)) / 64.0 AS hb, 1 - bit_count(xor(a.th, b.th)) / 64.0 AS tb
  FROM r a JOIN r b ON b.place < a.place AND b.place >= a.place - {dedupe.NEWEST} AND a.ms - b.ms <= {dedupe.WINDOW_MINUTES} * 60000),
h AS (SELECT *, 0.5 * CASE WHEN u = 0 THEN 1.0 ELSE c / u END + 0.5 * hb AS head FROM j),
s AS (SELECT *, greatest(head, (head + tb) / 2) AS s FROM h),
k AS (SELECT *, CASE WHEN same_link THEN 3 WHEN same_text THEN 2 WHEN s >= {dedupe.THRESHOLD} OR s >= {dedupe.ENTITY_FLOOR} AND known AND NOT parted THEN 1 END AS layer FROM s),
m AS (SELECT * FROM k WHERE layer IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY layer DESC, CASE WHEN layer = 1 THEN s ELSE 1 END DESC, newer DESC) = 1)
SELECT p.id, other AS matched_id, CASE layer WHEN 3 THEN 'DUPLICATE_URL' WHEN 2 THEN 'DUPLICATE_TEXT' WHEN 1 THEN 'DUPLICATE_TEXT' END AS reason,
  round(CASE WHEN layer = 1 THEN s WHEN layer > 1 THEN 1.0 END, 6) AS similarity
FROM p LEFT JOIN (SELECT * FROM m WHERE NOT (layer = 1 AND turned)) m ON m.id = p.id""")
def _(s, d):
    df = dedupe.find_duplicates(P.normalize(_posts(s, d)).select("id", "headline", "text", "url", "ts"))
    return df.withColumn("similarity", F.round("similarity", 6))


def _clustered(s: SparkSession, d: str) -> DataFrame:
    """Documents as posts to be clustered: a headline's two rarest words that stand in 2 to 20 headlines are its names, and words and figures its weight."""
    df = written(P.normalize(_posts(s, d)).select("id", "headline", "source_id", "ts"))
    each = written(df.select("id", F.explode(F.array_distinct(X.significant(X.tokenize(F.col("headline"))))).alias("word")))
    rare = each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n BETWEEN 2 AND 20")
    named = each.join(rare, "word").groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "word"))), 1, 2)["word"].alias("entities"))
    names = sorted(cluster.COMPATIBLE)
    kind = F.element_at(F.array(*(F.lit(c) for c in names)), (F.crc32(F.col("source_id").cast("binary")) % len(names) + 1).cast("int"))
    weight = F.least(F.lit(100.0), 40.0 + 2 * F.size(F.split("headline", " ")) + 5 * F.size(X.figures_in(F.col("headline"))))
    return df.join(named, "id", "left").select("id", "headline", kind.alias("category"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), weight.alias("importance"), "source_id", "ts")


@query("event_clusters")
def _(s, d):
    return cluster.cluster_posts(_clustered(s, d))


@query("stream_event_clusters")
def _(s, d):
    from tidewire.streaming.clusters import cluster_stream
    from tidewire.streaming.queries import drain_in_pieces

    return drain_in_pieces(written(_clustered(s, d)), "ts", cluster_stream)


def _posts(s: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.floor(key / 2) * 60)
    link = F.when(key % 10 == 3, F.concat(F.lit("https://www.wire.example/p/"), (F.floor(key / 20) % 50).cast("string"), F.lit("?utm_source=x")))
    return table(s, d, "documents").select(
        key.alias("id"), F.col("source").alias("source_id"), F.coalesce("text", F.lit("")).alias("text"), link.alias("url"), at.alias("ts"), at.alias("published_at"),
    )


@query("processed_posts")
def _(s, d):
    rows = _posts(s, d)
    names = rows.select("source_id").distinct()
    n = F.crc32(F.col("source_id").cast("binary"))
    sources = names.select(
        "source_id", (n % 10 > 0).alias("enabled"), F.when(n % 7 == 0, "manual").otherwise("rss").alias("source_type"), (70.0 + n % 30).alias("quality_score"),
        (n % 20).cast("double").alias("noise_score"), (n % 5 == 0).alias("official"), F.when(n % 3 == 0, "strict").otherwise("standard").alias("filter_profile"), F.lit("ECONOMIC").alias("category"),
    )
    df = P.process(rows, sources, SAMPLE)
    return df.withColumns({c: F.array_join(c, ",") for c in ("tickers", "countries", "channels")})


@query("stream_hourly_metrics", SQL["hourly_metrics"].replace("FROM events GROUP", "FROM events WHERE ts < (SELECT date_trunc('hour', max(ts) - INTERVAL 10 MINUTE) FROM events) GROUP"))
def _(s, d):
    from tidewire.sources.shared import work_dir
    from tidewire.streaming.queries import drain, hourly_metrics_stream

    schema = table(s, d, "events").schema
    # As a pattern, the table may be one file.
    stream = s.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    df = drain(hourly_metrics_stream(stream, "ts", "event_type", "value"), work_dir(s), s)
    return df.withColumn("total", r4(F.col("total"))).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("earnings_surprises", """
SELECT p_partkey, 'Q' || (p_size % 4 + 1) AS period, CAST(p_size + 0.25 AS DOUBLE) AS eps, CAST(p_size % 7 + 20.5 AS DOUBLE) AS eps_consensus,
  CASE WHEN abs(p_size + 0.25 - (p_size % 7 + 20.5)) / (p_size % 7 + 20.5) <= 0.005 THEN 'INLINE' WHEN p_size + 0.25 > p_size % 7 + 20.5 THEN 'BEAT' ELSE 'MISS' END AS eps_surprise,
  p_size * 1e9 AS revenue FROM part""")
def _(s, d):
    text = F.format_string("ACME Q%d EPS $%d.25 VS $%d.50 EST; revenue of $%dbn", F.col("p_size") % 4 + 1, "p_size", F.col("p_size") % 7 + 20, "p_size")
    df = earnings.with_earnings(table(s, d, "part").select("p_partkey", text.alias("text")), "text", "e")
    return df.select("p_partkey", "e.period", "e.eps", "e.eps_consensus", "e.eps_surprise", "e.revenue")


@query("market_impact", """
WITH p AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'FED' WHEN 1 THEN 'EQUITY' WHEN 2 THEN 'COMMODITY' WHEN 3 THEN 'GEOPOLITICAL' WHEN 4 THEN 'CRYPTO' ELSE 'EQUITY' END AS c,
    ['CRITICAL', 'HIGH', 'MODERATE', 'LOW', 'IGNORE'][p_size % 5 + 1] AS band, p_size % 3 = 0 AS deal, p_size % 11 = 0 AS war, p_size % 6 = 1 AND p_size % 4 = 1 AS mover FROM part),
r AS (SELECT *, CASE WHEN c = 'FED' OR war OR c = 'GEOPOLITICAL' OR mover THEN 'broad' WHEN c IN ('COMMODITY', 'CRYPTO') THEN 'sector' WHEN c = 'EQUITY' THEN 'single_name' ELSE 'none' END AS relevance FROM p)
SELECT p_partkey, relevance, CASE band WHEN 'CRITICAL' THEN true WHEN 'HIGH' THEN relevance IN ('broad', 'sector')
  WHEN 'MODERATE' THEN relevance = 'broad' OR deal AND relevance IN ('single_name', 'sector') ELSE false END AS market_moving, c = 'FED' AS macro FROM r""")  # fmt: skip
def _(s, d):
    size = F.col("p_size")
    category = F.element_at(F.array(*(F.lit(c) for c in ("FED", "EQUITY", "COMMODITY", "GEOPOLITICAL", "CRYPTO", "EQUITY"))), size % 6 + 1)
    band = F.element_at(F.array(*(F.lit(b) for b in ("CRITICAL", "HIGH", "MODERATE", "LOW", "IGNORE"))), size % 5 + 1)
    text = F.concat_ws(" ", "p_name", F.when(size % 3 == 0, "to acquire"), F.when(size % 11 == 0, "War"))
    ticker = F.when((size % 6 == 1) & (size % 4 == 1), "BIG").otherwise("SMALL")
    df = table(s, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text"), category.alias("category"), band.alias("band"), F.array(ticker).alias("tickers"))
    df = df.withColumn("countries", F.array(F.lit("US"))).withColumn("commodities", F.array(F.lit("WHEAT")))
    master = s.createDataFrame([("BIG", ["SPX"], 90), ("SMALL", ["SPX"], 50)], "ticker string, indices array<string>, priority int")
    verdict = impact.assess_impact(
        F.col("text"), F.col("category"), F.lit(None).cast("string"), F.col("band"), F.size("tickers"), F.col("has_mover"), F.col("countries"), F.col("commodities")
    )
    rows = impact.movers(df, master).select(F.col("id").alias("p_partkey"), verdict.alias("v"))
    return rows.select("p_partkey", "v.relevance", "v.market_moving", "v.macro")


@query("event_provenance", """
WITH r AS (SELECT l_partkey, l_suppkey, min(l_shipdate) AS seen FROM lineitem GROUP BY 1, 2),
s AS (SELECT l_partkey, seen, s_suppkey, ['x', 'rss', 'edgar', 'discord'][s_suppkey % 4 + 1] AS kind,
  ['x:', 'rss:', 'edgar:', 'discord:'][s_suppkey % 4 + 1] || s_suppkey AS source_id, s_name, s_nationkey FROM r JOIN supplier ON s_suppkey = l_suppkey)
SELECT l_partkey, array_to_string(list_filter(['x', 'discord', 'rss', 'edgar'], lambda o: list_contains(list(kind), o)), ',') AS origins,
  string_agg(s_name, ' + ' ORDER BY seen, source_id) AS label, count(DISTINCT s_nationkey) AS confirmed_by, count(DISTINCT s_nationkey) > 1 AS corroborated,
  min(seen) AS first_reported_at FROM s GROUP BY 1""")
def _(s, d):
    suppliers = table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    df = table(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate").join(suppliers, F.col("s_suppkey") == F.col("l_suppkey"))
    prefix = F.element_at(F.array(*(F.lit(p) for p in ("x:", "rss:", "edgar:", "discord:"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    no = F.lit(None).cast("string")
    posts = df.select(
        "l_partkey", F.concat(prefix, F.col("s_suppkey").cast("string")).alias("source_id"), F.col("s_name").alias("source_name"), F.col("s_nationkey").cast("string").alias("org"),
        no.alias("author"), no.alias("origin_author"), no.alias("origin_channel"), no.alias("carrier"), F.lit(None).cast("boolean").alias("preserved"),
        no.alias("publisher"), no.alias("publisher_org"), F.col("l_shipdate").cast("timestamp").alias("first_seen_at"),
    )
    rows = provenance.provenance_of(provenance.attribute(posts), "l_partkey")
    return rows.withColumn("first_reported_at", F.col("first_reported_at").cast("timestamp_ntz"))


_REPLAY_AT = "1998-01-01 00:00:00"


@query("delivery_replay", f"""
WITH d AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '{_REPLAY_AT}' - INTERVAL 5 MINUTE),
e AS (SELECT l_orderkey, arg_max(l_shipdate, l_extendedprice * 100 - l_linenumber * 0.001) AS seen, arg_max(l_linenumber, l_extendedprice * 100 - l_linenumber * 0.001) AS line
  FROM lineitem WHERE l_orderkey % 13 > 0 GROUP BY 1),
f AS (SELECT o_orderkey AS event_id, 'line ' || line AS headline, seen, line IS NULL AS missing, CASE WHEN seen > TIMESTAMP '{_REPLAY_AT}' + INTERVAL 5 MINUTE THEN 'future'
  WHEN seen < TIMESTAMP '{_REPLAY_AT}' - INTERVAL 700 DAY THEN 'stale' END AS why FROM d LEFT JOIN e ON l_orderkey = o_orderkey)
SELECT event_id, headline, CASE WHEN missing THEN 'UNRESOLVABLE' WHEN why IS NULL THEN 'READY' ELSE 'SKIPPED' END AS result,
  CASE WHEN missing THEN 'no stored event' ELSE why END AS reason FROM f""")
def _(s, d):
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "P", "PENDING").otherwise("SENT")
    deliveries = table(s, d, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.lit("desk").alias("destination"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("claimed_at")
    )
    events = table(s, d, "lineitem").where("l_orderkey % 13 > 0").select(
        F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("id"), F.col("l_extendedprice").alias("importance"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("headline"), F.col("l_shipdate").alias("published_at"),
    )
    due = replay.due_deliveries(deliveries, ts(_REPLAY_AT), "desk")
    return replay.replay_outcomes(due, events, ts(_REPLAY_AT), 700 * 24 * 60).drop("published_at")


@query("alert_actions", """
WITH a AS (SELECT o_orderkey AS event_id, unnest(['news', 'spx']) AS channel, o_orderkey % 3 = 0 AS supersedes FROM orders)
SELECT event_id, channel, CASE WHEN NOT (channel = 'news' AND event_id % 2 = 0) THEN 'POST' WHEN supersedes AND event_id % 5 > 0 THEN 'EDIT' ELSE 'NONE' END AS action FROM a""")
def _(s, d):
    key = F.col("o_orderkey")
    alerts = table(s, d, "orders").select(key.alias("event_id"), F.array(F.lit("news"), F.lit("spx")).alias("channels"), F.lit("new").alias("content"), (key % 3 == 0).alias("supersedes"))
    old = F.when(key % 5 == 0, "new").otherwise("old")
    sent = table(s, d, "orders").where(key % 2 == 0).select(key.alias("event_id"), F.lit("news").alias("channel"), key.cast("string").alias("message_id"), old.alias("content"))
    return replay.alert_actions(alerts, sent).select("event_id", "channel", "action")


@query("relay_origins", """
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'text_prefix' WHEN role = 'user' THEN 'message_link' ELSE 'direct' END AS method,
  CASE WHEN role = 'assistant' THEN 'Desk' WHEN role = 'user' THEN NULL ELSE 'bot' END AS origin_author,
  CASE WHEN role = 'assistant' THEN 'wire' WHEN role = 'user' THEN CAST(conv_id + 10000 AS VARCHAR) END AS origin_channel FROM conversations""")
def _(s, d):
    role = F.col("role")
    link = F.concat(F.lit("https://discord.com/channels/@me/"), (F.col("conv_id") + 10000).cast("string"), F.lit("/"), (F.col("turn") + 10000).cast("string"))
    content = F.when(role == "assistant", F.lit("[#wire] Desk: what was said")).when(role == "user", F.concat(F.lit("said there "), link)).otherwise("plain words")
    no = F.lit(None).cast("string")
    df = table(s, d, "conversations").select(
        "conv_id", "turn", F.lit("bot").alias("carrier"), content.alias("content"), no.alias("embed_author"), no.alias("embed_footer"), no.alias("embed_text"),
        F.lit(None).cast("struct<channel_id:string,message_id:string>").alias("crosspost"),
        F.lit(None).cast("struct<channel_id:string,message_id:string,content:string,embed_author:string,embed_footer:string>").alias("forward"),
    )
    return relay.recover_origin(df).select("conv_id", "turn", "method", "origin_author", "origin_channel")


@query("relay_bodies", """
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'Macro Alert' WHEN role = 'user' THEN 'Wire' END AS author,
  CASE WHEN role = 'assistant' THEN '@desk' || conv_id WHEN role = 'user' THEN '@a_' || turn END AS handle,
  CASE WHEN role = 'assistant' THEN 'line ' || turn || chr(10) || chr(10) || 'more' || chr(10) || '2024-01-01 08:30' WHEN role = 'user' THEN 'HEADLINE' || chr(10) || 'of @someone else' ELSE 'plain words' END AS text,
  CASE WHEN role = 'assistant' THEN TIMESTAMP '2024-01-01 08:30:00' END AS published_at FROM conversations""")
def _(s, d):
    role, conv, turn = F.col("role"), F.col("conv_id").cast("string"), F.col("turn").cast("string")
    text = (
        F.when(role == "assistant", F.concat(F.lit("Macro Alert (@desk"), conv, F.lit("):\nline "), turn, F.lit("\n\nmore\n2024-01-01 08:30\nhttps://x.com/a/status/1")))
        .when(role == "user", F.concat(F.lit("**Wire (@a_"), turn, F.lit("): HEADLINE\nof @someone else"))).otherwise("plain words")
    )
    body = relay.parse_relay_body(text, ts(NOW).cast("timestamp"))
    df = table(s, d, "conversations").select("conv_id", "turn", body.alias("b")).select("conv_id", "turn", "b.author", "b.handle", "b.text", "b.published_at")
    return df.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("link_strip", r"""SELECT doc_id, regexp_replace(regexp_replace(text, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), 'https?://\S+|www\.\S+', '', 'g') AS text FROM documents""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", X.strip_links(F.col("text")).alias("text"))


@query("option_contracts", r"""SELECT doc_id, coalesce(regexp_matches(text, '(?i)\b\d+\s*[PC]\b'), false) AS has_contract FROM documents""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", X.names_contract(F.col("text")).alias("has_contract"))


@query("boilerplate_strip", r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(?:All rights reserved|Licensed under)', '', 'g'),
  '(?i)<t:\d+(?::[a-z])?>\s*[-—–:]?\s*', '', 'g'), '(?i)\b\d{1,2}:\d{2}\s*(?:AM|PM)?\s*[-—–:]\s*', '', 'g'), '\*\*\[[^\]]*\]\(\s*\)[^\n]*?\*\*\s*_\*\s*\*_\s*$', ''),
  '^[\s*:-]+|[\s*:-]+$', '', 'g')) AS text FROM documents""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", X.strip_boilerplate(F.col("text"), ("All rights reserved", "Licensed under")).alias("text"))


@query("listed_headlines", r"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\b(\d{1,2}:\d{2}\s*[AP]M\b)', chr(10) || '\1', 'g'), chr(10)),
  lambda x: regexp_replace(trim(x), '^[•\-\s]+', '')), lambda x: length(x) > 5) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(place - 1 AS INTEGER) AS place, l[place] AS headline FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS place FROM p)""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(X.headlines_in(F.col("text"))).alias("place", "headline"))


@query("debounced_warnings", """
WITH RECURSIVE e AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'error'),
r AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY 1
  UNION ALL SELECT r.user_id, min(e.ts) FROM r JOIN e ON e.user_id = r.user_id AND epoch_ms(e.ts) >= epoch_ms(r.ts) + 1800000 GROUP BY r.user_id, r.ts)
SELECT user_id, ts FROM r""")
def _(s, d):
    errors = table(s, d, "events").where("event_type = 'error'").select("user_id", "ts")
    return reports.debounced(errors, "user_id", "ts").where("warn").select("user_id", "ts")


@query("watchlist_feeds", """
SELECT 'rss:' || kind || ':' || lower(n_name) AS id, upper(n_name) AS ticker, kind, 'https://' || kind || '/' || upper(n_name) AS url
FROM nation, (VALUES ('filings'), ('news')) k(kind) WHERE NOT (kind = 'news' AND n_nationkey % 2 = 0)""")
def _(s, d):
    names = table(s, d, "nation").select(F.col("n_name").alias("ticker"))
    known = table(s, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("rss:news:"), F.lower("n_name")).alias("id"))
    return feeds.watchlist_feeds([names, names], known, {"news": "https://news/{ticker}", "filings": "https://filings/{ticker}"})


@query("filing_sentences", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand || ', files for bankruptcy; change in control' WHEN p_size % 3 = 1 THEN p_brand || ' files 8-K — ' || p_name
  ELSE p_name || ' — ' || p_type END AS sentence FROM part""")
def _(s, d):
    size = F.col("p_size") % 3
    items = F.when(size == 0, F.array(F.lit("1.03"), F.lit("5.01"))).otherwise(F.array(F.lit("9.01")))
    company = F.when(size < 2, F.col("p_brand"))
    return table(s, d, "part").select("p_partkey", feeds.describe_filing(company, F.lit("8-K"), items, F.col("p_name"), F.col("p_type")).alias("sentence"))


def _counted(table: str, key: str) -> str:
    return f"(SELECT '{{' || string_agg('\"' || k || '\":' || n, ',' ORDER BY k) || '}}' FROM (SELECT {key} AS k, count(*) AS n FROM {table} GROUP BY 1))"


@query("metrics_document", _HEALTH + f""",
r AS (SELECT *, CASE WHEN event_type = 'error' THEN 'FILTERED' ELSE 'PUBLISHED' END AS status FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY)
SELECT {_counted("r", "status")} AS events, {_counted("(SELECT 'NOISE' AS x FROM r WHERE status = 'FILTERED')", "x")} AS rejections,
  {_counted("r", "event_type || '/' || status")} AS deliveries, {_counted("e", "state")} AS health""")
def _(s, d):
    kind = F.col("event_type")
    status = F.when(kind == "error", "FILTERED").otherwise("PUBLISHED")
    events = table(s, d, "events").select(status.alias("status"), F.when(kind == "error", "NOISE").alias("rejection_reason"), "ts")
    deliveries = table(s, d, "events").select(kind.alias("destination"), status.alias("status"), F.col("ts").alias("created_at"))
    return reports.metrics_document(events, deliveries, _health(s, d), "ts", ts(NOW))


@query("desk_payloads", """
SELECT 'e' || p_partkey AS event_id, '{"eventId":"e' || p_partkey || '","slug":"","postId":null,"headline":"' || p_name || '","body":"","category":"EQUITY","subcategory":null,"severity":"'
  || CASE WHEN p_size % 2 = 0 THEN 'HIGH' ELSE 'LOW' END || '","macro":false,"marketRelevance":"none","marketMoving":' || (p_size % 3 = 0) || ',"tickers":["' || p_brand || '"],"countries":[],"entities":[],'
  || '"publishedAt":"2024-01-01T00:' || lpad(CAST(p_size % 60 AS VARCHAR), 2, '0') || ':00.000Z","detectedAt":null,"sentAt":"2024-01-30T12:00:00.000Z","sourceCount":' || p_size % 4 + 1 || '}' AS payload FROM part""")
def _(s, d):
    size = F.col("p_size")
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(size % 60).cast("int"))
    events = table(s, d, "part").select(
        F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("event_id"), F.col("p_name").alias("headline"), F.lit("EQUITY").alias("category"),
        F.when(size % 2 == 0, "HIGH").alias("band"), (size % 3 == 0).alias("market_moving"), F.array("p_brand").alias("tickers"), at.alias("published_at"), (size % 4 + 1).alias("source_count"),
    )
    return desk.payload(events.withColumn("id", F.col("event_id")), ts(NOW))


@query("relay_routes", """
SELECT DISTINCT conv_id, turn, destination FROM conversations JOIN (VALUES ('user', 'a', '', 'all users with an a'), ('user', NULL, 'the', 'users who say the'), ('assistant', 'ANSWER', NULL, 'answers'),
  ('assistant', 'nobody', NULL, 'none')) r(channel, author, contains, destination) ON channel = role
WHERE (coalesce(author, '') = '' OR contains(lower('answerer' || conv_id % 3), lower(author))) AND (coalesce(contains, '') = '' OR contains(lower(coalesce(text, '')), lower(contains)))""")
def _(s, d):
    rows = [("user", "a", "", "all users with an a"), ("user", None, "the", "users who say the"), ("assistant", "ANSWER", None, "answers"), ("assistant", "nobody", None, "none")]
    routes = s.createDataFrame(rows, "channel string, author string, contains string, destination string")
    author = F.concat(F.lit("answerer"), (F.col("conv_id") % 3).cast("string"))
    messages = table(s, d, "conversations").select("conv_id", "turn", F.col("role").alias("channel"), author.alias("author"), "text")
    return desk.routed(messages, routes).select("conv_id", "turn", "destination").distinct()


@query("run_budget", """
SELECT o_orderkey, coalesce(sum(o_orderkey % 3 + 1.5) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 60 AS deferred
FROM (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 100)""")
def _(s, d):
    due = table(s, d, "orders").where("o_orderstatus = 'P'").withColumn("seconds", F.col("o_orderkey") % 3 + F.lit(1.5))
    return desk.within_run(due, ["o_orderdate", "o_orderkey"], "seconds", 60).select("o_orderkey", "deferred")


@query("as_of_join", """
SELECT a.event_id, CASE WHEN epoch_ms(a.ts) - epoch_ms(b.ts) <= 6 * 3600000 THEN b.view_id END AS view_id
FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') a
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def _(s, d):
    df = table(s, d, "events")
    views = df.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    found = desk.as_of(df.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", 6 * 3_600_000)
    return found.select("event_id", F.col("match.view_id").alias("view_id"))


@query("since_times", f"""
SELECT p_partkey, CASE p_size % 5 WHEN 4 THEN NULL ELSE TIMESTAMP '{NOW}' - to_seconds(p_size * [1, 60, 3600, 86400][p_size % 5 + 1]) END AS since FROM part""")
def _(s, d):
    size = F.col("p_size")
    unit = F.element_at(F.array(*(F.lit(u) for u in ("s", "m", "H", "d", "weeks"))), size % 5 + 1)
    since = desk.since_time(F.concat(size.cast("string"), unit), ts(NOW))
    return table(s, d, "part").select("p_partkey", since.cast("timestamp_ntz").alias("since"))


@query("logged_documents", """
SELECT p_partkey, '{"id":' || p_partkey || ',"apiKey":"[redacted]","deep":{"a":{"b":{"c":{"d":{"e":"[truncated]"}}}}},"list":[{"Token":"[redacted]"},"' || p_brand || '"]}' AS document FROM part""")
def _(s, d):
    text = F.format_string('{"id": %d, "apiKey": "k%d", "deep": {"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}}, "list": [{"Token": {"x": 1}}, "%s"]}', "p_partkey", "p_partkey", "p_brand")
    return table(s, d, "part").select("p_partkey", desk.without_secrets(text).alias("document"))


@query("mastheads", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'Wire-Desk' ELSE NULL END AS masthead FROM supplier")
def _(s, d):
    key = F.col("s_suppkey") % 3
    name = F.when(key == 0, F.concat(F.lit(" "), "s_name", F.lit(" — Markets - more"))).when(key == 1, "Wire-Desk").otherwise("  ")
    return table(s, d, "supplier").select("s_suppkey", desk.masthead(name).alias("masthead"))


@query("tolerant_arrays", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_brand || ',2' ELSE '' END AS items FROM part""")
def _(s, d):
    size = F.col("p_size") % 4
    text = F.when(size == 0, F.format_string('["%s", 2, null]', "p_brand")).when(size == 1, "{broken").when(size == 2, '{"a": 1}')
    return table(s, d, "part").select("p_partkey", F.array_join(desk.strings_of(text), ",").alias("items"))


@query("retained_rows", "SELECT 'events' AS name, count(*) AS rows FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'pages', count(*) FROM pages")
def _(s, d):
    return desk.retained_rows({n: table(s, d, n) for n in ("events", "orders", "pages")})


@query("verdict_changes", """
WITH v AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'NOISE_MEME' WHEN value < 5 THEN 'BELOW_THRESHOLD' ELSE 'PUBLISHED' END AS was,
  CASE WHEN event_type = 'error' AND value < 50 THEN 'NOISE_MEME' WHEN value < 10 THEN 'BELOW_THRESHOLD' ELSE 'PUBLISHED' END AS now FROM events)
SELECT was, now, count(*) AS n, CAST(now = 'PUBLISHED' AS DOUBLE) AS acceptance_rate FROM v GROUP BY 1, 2""")
def _(s, d):
    kind, value = F.col("event_type"), F.col("value")
    def judged(noise, least):
        reason = F.when(noise, "NOISE_MEME").when(value < least, "BELOW_THRESHOLD")
        return table(s, d, "events").select(F.col("event_id").alias("id"), reason.alias("rejection_reason"), score.status_of(reason).alias("status"))

    return desk.verdict_changes(judged(kind == "error", 5), judged((kind == "error") & (value < 50), 10))


def _event_stream(s: SparkSession, d: str) -> DataFrame:
    # As a pattern, the table may be one file.
    return s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(s: SparkSession, stream: DataFrame) -> DataFrame:
    from tidewire.sources.shared import work_dir
    from tidewire.streaming.queries import drain

    return drain(stream, work_dir(s), s)


@query("stream_landing", "SELECT DISTINCT user_id, event_type FROM events")
def _(s, d):
    from tidewire.streaming.queries import land_stream

    return _drained(s, land_stream(_event_stream(s, d).select("user_id", "event_type", "ts"), ("user_id", "event_type"), "ts")).select("user_id", "event_type")


@query("stream_health", """
WITH e AS (SELECT user_id, ts, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island, event_id FROM events),
n AS (SELECT *, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS failures FROM e),
t AS (SELECT *, CASE WHEN failures >= 3 THEN 'DISCONNECTED' WHEN failures > 0 THEN 'ERROR' ELSE 'ACTIVE' END AS state FROM n),
l AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'ACTIVE') AS before FROM t)
SELECT CAST(user_id AS VARCHAR) AS source_id, ts, failures AS consecutive_failures, state FROM l WHERE state <> before""")
def _(s, d):
    from tidewire.streaming.queries import health_stream

    polls = _event_stream(s, d).select(F.col("user_id").cast("string").alias("source_id"), "ts", (F.col("event_type") != "error").alias("ok"))
    return _drained(s, health_stream(polls)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_recent_duplicates", """
SELECT a.event_id AS id, b.event_id AS earlier_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 90 MINUTE""")
def _(s, d):
    from tidewire.streaming.queries import recent_duplicates_stream

    posts = _event_stream(s, d).select(F.col("event_id").alias("id"), F.concat_ws("|", "user_id", "event_type").alias("key"), "ts")
    return _drained(s, recent_duplicates_stream(posts, "key", "ts")).select("id", "earlier_id")


@query("feed_items", """
SELECT 'feed' || p_partkey AS source_id, CASE WHEN p_size % 3 = 0 THEN 'http://a.com/' || p_partkey ELSE 'g' || p_partkey END AS source_post_id, p_name || ' & more' AS title,
  p_name || ' & more — ' || p_type AS text, 'http://a.com/' || p_partkey AS url,
  CASE WHEN p_size % 2 = 0 THEN make_timestamp(2026, 5, p_size % 28 + 1, 12, 0, 0) WHEN p_size % 5 > 0 THEN make_timestamp(2026, 5, p_size % 28 + 1, 12, 0, 0) END AS published_at FROM part""")
def _(s, d):
    size, day = F.col("p_size"), F.col("p_size") % 28 + 1
    guid = F.when(size % 3 > 0, F.format_string("<guid isPermaLink=\"false\">g%d</guid>", "p_partkey")).otherwise("")
    dated = F.when(size % 5 > 0, F.format_string("<pubDate>%d May 2026 12:00:00 GMT</pubDate>", day)).otherwise("")
    item = "<title>%s &amp; more</title><link>http://a.com/%d</link>%s%s<description>&lt;p&gt;%s&lt;/p&gt;</description>"
    rss = F.concat(F.lit("<rss><channel><title>t</title><item>"), F.format_string(item, "p_name", "p_partkey", guid, dated, "p_type"), F.lit("</item></channel></rss>"))
    entry = "<feed><title>f</title><entry><title>%s &amp; more</title><id>%s</id><updated>2026-05-%02dT12:00:00Z</updated><link href=\"http://a.com/%d\" rel=\"alternate\"/><summary>%s</summary></entry></feed>"
    id_ = F.when(size % 3 > 0, F.format_string("g%d", "p_partkey")).otherwise("")
    atom = F.format_string(entry, "p_name", id_, day, "p_partkey", "p_type")
    docs = table(s, d, "part").select(F.format_string("feed%d", "p_partkey").alias("source_id"), F.when(size % 2 == 0, atom).otherwise(rss).alias("xml"))
    return feeds.parse_feed(docs).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("filing_entries", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '8-K' ELSE 'SC 13D/A' END AS form, upper(p_name) AS company, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS cik,
  lpad(CAST(p_partkey AS VARCHAR), 10, '0') || '-26-000012' AS accession FROM part""")
def _(s, d):
    form = F.when(F.col("p_size") % 2 == 0, "8-K").otherwise("SC 13D/A")
    title = F.format_string("%s - %s (%010d) (Filer)", form, F.upper("p_name"), "p_partkey")
    url = F.format_string("https://filings.example/data/%010d-26-000012-index.htm", "p_partkey")
    df = table(s, d, "part").select("p_partkey", feeds.filing_title(title).alias("f"), feeds.accession(url).alias("accession"))
    return df.select("p_partkey", "f.form", "f.company", "f.cik", "accession")


@query("chat_messages", """
SELECT CASE WHEN turn % 4 = 1 THEN NULL ELSE conv_id || '-' || turn END AS source_post_id,
  CASE turn % 4 WHEN 0 THEN 'hello ' || conv_id || chr(10) || chr(10) || 'T' || chr(10) || chr(10) || 'n: v' WHEN 2 THEN 'x' ELSE '' END AS text,
  CASE turn % 4 WHEN 1 THEN 'malformed' WHEN 2 THEN 'version' WHEN 3 THEN 'empty' END AS reject_reason FROM conversations""")
def _(s, d):
    turn = F.col("turn") % 4
    good = '{"version":1,"id":"%d-%d","channel_id":"c","author":"Ann","content":"hello %d","embeds":[{"title":"T","fields":[{"name":"n","value":"v"}]}]}'
    payload = (
        F.when(turn == 0, F.format_string(good, "conv_id", "turn", "conv_id")).when(turn == 1, "{broken")
        .when(turn == 2, F.format_string('{"version":2,"id":"%d-%d","content":"x"}', "conv_id", "turn")).otherwise(F.format_string('{"version":1,"id":"%d-%d"}', "conv_id", "turn"))
    )
    df = feeds.parse_chat(table(s, d, "conversations").select(payload.alias("payload")))
    return df.select("source_post_id", F.coalesce("text", F.lit("")).alias("text"), "reject_reason")


@query("news_items", f"""
SELECT 'agg:' || CASE WHEN p_size % 2 = 0 THEN 'crypto' ELSE 'other' END AS source_id, 'news:' || p_partkey AS source_post_id, CASE WHEN p_size % 2 = 0 THEN 'crypto' ELSE 'general' END AS category,
  p_name || ' & co — ' || p_type AS text, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS publisher_org, 'A,B' AS tickers,
  CASE WHEN p_size % 7 > 0 THEN TIMESTAMP '{NOW}' - to_minutes(CAST(p_size AS BIGINT)) END AS published_at FROM part WHERE p_size <= 30 OR p_size % 7 = 0""")
def _(s, d):
    size = F.col("p_size")
    at = F.when(size % 7 == 0, 0).otherwise(F.unix_timestamp(ts(NOW).cast("timestamp")) - size * 60)
    item = '[{"id":%d,"datetime":%d,"headline":"%s &amp; co","source":"%s","summary":"%s","related":"A,B"},{"id":%d,"datetime":0,"headline":""}]'
    text = F.format_string(item, "p_partkey", at, "p_name", "p_brand", "p_type", "p_partkey")
    df = table(s, d, "part").select(F.concat(F.lit("agg:"), F.when(size % 2 == 0, "crypto").otherwise("other")).alias("source_id"), text.alias("payload"))
    rows = feeds.parse_news(df, ts(NOW), 30)
    return rows.select("source_id", "source_post_id", "category", "text", "publisher_org", F.array_join("tickers", ",").alias("tickers"), F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query("feed_summaries", f"""
WITH g AS (SELECT user_id AS source_id, count(*) AS n_items, max(CASE WHEN user_id % 4 > 0 THEN ts END) AS newest FROM events GROUP BY 1)
SELECT source_id, n_items, (epoch_us(TIMESTAMP '{NOW}') // 1000 - epoch_us(newest) // 1000) / 60000.0 AS newest_age_minutes, CASE WHEN newest IS NULL THEN 'undated' ELSE 'usable' END AS kind FROM g""")
def _(s, d):
    items = table(s, d, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").cast("string").alias("source_post_id"), F.when(F.col("user_id") % 4 > 0, F.col("ts")).alias("published_at"))
    return feeds.summarize_feeds(items.withColumn("published_at", F.col("published_at").cast("timestamp")), ts(NOW))


@query("stream_feed_outcomes", """
WITH p AS (SELECT page_id, page_id % 20 AS feed, page_id // 20 AS k, page_id % 11 = 0 AS bad, page_id % 13 = 0 AS same, page_id // 40 AS v FROM pages),
d AS (SELECT *, lag(CASE WHEN NOT bad AND NOT same THEN v END IGNORE NULLS) OVER (PARTITION BY feed ORDER BY k) AS before FROM p),
q AS (SELECT *, NOT bad AND (same OR v IS NOT DISTINCT FROM before) AS quiet FROM d)
SELECT 'feed ' || feed AS source_id, make_timestamp(1704067200000000 + page_id * 60000000) AS polled_at, NOT bad AS ok, quiet,
  CAST(CASE WHEN bad OR quiet THEN 0 ELSE v % 4 + 1 END AS INTEGER) AS items, CASE WHEN bad THEN 'HTTP ' || (400 + page_id % 100) END AS error FROM q""")
def _(s, d):
    from tidewire.sources import polls
    from tidewire.sources.shared import work_dir
    from tidewire.streaming.queries import drain

    polls.register(s)
    path, key = work_dir(s), F.col("page_id")
    version = F.floor(key / 40)
    item = lambda i: F.format_string("<item><title>story %d of %d</title><guid>%d-%d</guid></item>", i, version, version, i)
    xml = F.concat(F.lit("<rss><channel><title>t</title>"), F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), version % 4), item), ""), F.lit("</channel></rss>"))
    rows = table(s, d, "pages").select(
        F.format_string("feed %d", key % 20).alias("source_id"), F.timestamp_seconds(F.lit(1_704_067_200) + key * 60).alias("polled_at"),
        F.when(key % 13 == 0, "").otherwise(xml).alias("xml"), F.when(key % 11 == 0, F.format_string("HTTP %d", 400 + key % 100)).alias("error"), "page_id",
    )
    half = rows.agg(F.max("page_id")).first()[0]
    found = None
    for part in (F.col("page_id") <= F.lit(half) / 2, F.col("page_id") > F.lit(half) / 2):
        polls.write_polls(rows.where(part), f"{path}/feeds")
        found = drain(polls.outcomes(s.readStream.format("feed_polls").load(f"{path}/feeds")), path, s)
    return found.withColumn("polled_at", F.col("polled_at").cast("timestamp_ntz"))


@query("stream_new_items", """
WITH i AS (SELECT user_id, event_id, event_type || '-' || (event_id // 60) AS item, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) // 1000 AS poll, ts AS place,
    CASE WHEN event_id % 9 > 0 THEN epoch_us(ts) // 1000 - CASE WHEN event_id % 7 = 0 THEN 86400000 * (event_id % 3) ELSE 0 END END AS published FROM events),
w AS (SELECT *, max(published) OVER (PARTITION BY user_id ORDER BY poll RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest, min(poll) OVER (PARTITION BY user_id) AS first FROM i),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY poll, place, event_id) AS n FROM w WHERE poll = first OR newest IS NULL OR published IS NULL OR published >= newest),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(published, poll) DESC, place DESC, event_id DESC) AS back FROM a WHERE n = 1 AND poll = first AND (published IS NULL OR poll - published <= 900000))
SELECT CAST(user_id AS VARCHAR) AS source_id, item AS item_id, poll AS polled_ms, published AS published_ms, poll = first AS first FROM a WHERE n = 1 AND poll > first
UNION ALL SELECT CAST(user_id AS VARCHAR), item, poll, published, true FROM f WHERE back <= 5""")
def _(s, d):
    from tidewire.streaming.queries import drain_in_pieces
    from tidewire.streaming.stateful import new_items_stream

    at, key = F.col("ts").cast("timestamp"), F.col("event_id")
    late = F.when(key % 7 == 0, F.make_interval(days=(key % 3).cast("int"))).otherwise(F.make_interval())
    rows = table(s, d, "events").select(
        F.col("user_id").cast("string").alias("source_id"), F.concat_ws("-", "event_type", F.floor(key / 60)).alias("item_id"), F.window(at, "6 hours")["start"].alias("polled_at"),
        F.unix_micros(at).alias("place"), F.when(key % 9 > 0, at - late).alias("published_at"), "event_id",
    )
    return drain_in_pieces(rows, "polled_at", new_items_stream)


@query("stream_health_timers", """
WITH p AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, bool_and(event_type <> 'error') AS ok, bool_or(event_type IN ('purchase', 'signup')) AS item FROM events GROUP BY ALL),
n AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms) AS island FROM p),
f AS (SELECT *, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY ms) AS INTEGER) AS failures,
    max(CASE WHEN item THEN ms END) OVER (PARTITION BY user_id ORDER BY ms) AS last, lead(ms) OVER (PARTITION BY user_id ORDER BY ms) AS next FROM n),
ticks AS (SELECT user_id, ms AS at_ms, failures, last FROM f
  UNION ALL SELECT user_id, last + 21600001 * 1, failures, last FROM f WHERE last + 21600001 > ms AND last + 21600001 < coalesce(next, (SELECT max(epoch_us(ts) // 1000) - 600000 FROM events) + 1)
  UNION ALL SELECT user_id, last + 64800001, failures, last FROM f WHERE last + 64800001 > ms AND last + 64800001 < coalesce(next, (SELECT max(epoch_us(ts) // 1000) - 600000 FROM events) + 1)),
t AS (SELECT *, CASE WHEN failures >= 3 THEN 'DISCONNECTED' WHEN failures > 0 THEN 'ERROR' WHEN last IS NULL OR at_ms - last > 64800000 THEN 'STALE' WHEN at_ms - last > 21600000 THEN 'DELAYED' ELSE 'ACTIVE' END AS state FROM ticks),
c AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY at_ms), 'ACTIVE') AS before FROM t)
SELECT CAST(user_id AS VARCHAR) AS source_id, at_ms, state, failures AS consecutive_failures FROM c WHERE state <> before""")
def _(s, d):
    from tidewire.streaming.queries import drain_in_pieces
    from tidewire.streaming.stateful import health_timers_stream

    rows = table(s, d, "events").groupBy(F.col("user_id").cast("string").alias("source_id"), F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ts"))
    rows = rows.agg(F.bool_and(F.col("event_type") != "error").alias("ok"), F.max(F.col("event_type").isin("purchase", "signup").cast("int")).alias("items"))
    return drain_in_pieces(rows, "ts", lambda x: health_timers_stream(x, 21_600_000))


@query("stream_retries")
def _(s, d):
    """Jobs of users: sign-ups queue them, errors and purchases are outcomes; times are a thousandth of the events', so that retries fall between them."""
    from tidewire.streaming.queries import drain_in_pieces
    from tidewire.streaming.stateful import retries_stream

    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "ok").otherwise("queued")
    at = F.timestamp_millis(F.lit(1_704_067_200_000) + F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1_704_067_200_000_000)) / 1_000_000))
    return drain_in_pieces(table(s, d, "events").select(F.col("user_id").alias("job_id"), at.alias("ts"), F.col("event_id").alias("place"), kind.alias("kind")), "ts", retries_stream)


@query("stream_ledger", """
SELECT event_id, min(payload) AS payload FROM (SELECT 'event ' || (p_partkey // 3) AS event_id, '{"part":' || p_partkey || ',"name":"' || p_name || '"}' AS payload FROM part) GROUP BY 1""")
def _(s, d):
    from tidewire.sources.shared import work_dir
    from tidewire.streaming import ledger

    path = work_dir(s)
    parts = s.readStream.schema(table(s, d, "part").schema).parquet(f"{d}/part.parque[t]")
    event = F.format_string("event %d", F.floor(F.col("p_partkey") / 3)).alias("event_id")
    payloads = parts.select(event, F.to_json(F.struct(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"))).alias("payload"))
    for _ in range(2):
        # The second run finds nothing new, and delivers nothing twice.
        ledger.deliver(payloads, f"{path}/ledger", f"{path}/checkpoint").awaitTermination()
    return ledger.delivered(s, f"{path}/ledger").select("event_id", "payload")


@query("sketched_percentiles", "SELECT event_type, count(*) AS n, true AS p50_near, true AS p95_near, true AS users_near FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY 1")
def _(s, d):
    """Quantiles and distinct users merged from hourly sketches, held against the exact ones: ranks within 3 % of what was asked, counts within 5 %."""
    events, low, high = table(s, d, "events"), ts("2024-01-05"), ts("2024-01-25")
    stored = written(sketches.hourly_sketches(events, "ts", ["event_type"], "value", "user_id"))
    found = sketches.percentile_range(stored, ["event_type"], [0.5, 0.95], low, high).join(sketches.distinct_range(stored, ["event_type"], low, high), "event_type")
    exact = events.where((F.col("ts") >= low) & (F.col("ts") < high)).join(F.broadcast(found.drop("n")), "event_type").groupBy("event_type", "members")
    share = lambda p: (F.avg((F.col("value") < F.col(p)).cast("double")), F.avg((F.col("value") <= F.col(p)).cast("double")))
    rows = exact.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), *(c.alias(f"{p}_{i}") for p in ("p50", "p95") for i, c in enumerate(share(p))))
    near = lambda p, at: ((F.col(f"{p}_0") <= at + 0.03) & (F.col(f"{p}_1") >= at - 0.03)).alias(f"{p}_near")
    return rows.select("event_type", "n", near("p50", 0.5), near("p95", 0.95), (F.abs(F.col("members") - F.col("users")) <= 0.05 * F.col("users")).alias("users_near"))


@query("bucketed_upsert", """
SELECT o_orderkey, arg_max(o_orderstatus, v) AS o_orderstatus, arg_max(o_totalprice, v) AS o_totalprice, max(v) AS version FROM (
  SELECT o_orderkey, o_orderstatus, o_totalprice, 0 AS v FROM orders UNION ALL SELECT o_orderkey, 'X', o_totalprice + 1, 1 FROM orders WHERE o_orderkey % 50 = 7) GROUP BY 1""")
def _(s, d):
    from tidewire.sources.shared import work_dir

    path = f"{work_dir(s)}/orders"
    rows = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(0).alias("version"))
    buckets.create_table(rows, path, ["o_orderkey"], "version")
    changes = rows.where("o_orderkey % 50 = 7").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(1).alias("version"))
    buckets.upsert_table(s, path, changes, ["o_orderkey"], "version")
    return s.read.parquet(path).drop("bucket")


@query("stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 14400000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
r AS (SELECT user_id AS key, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM s GROUP BY user_id, k)
SELECT * FROM r WHERE last_at + INTERVAL 4 HOUR < (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def _(s, d):
    from tidewire.streaming.queries import drain_in_pieces, sessions_stream

    rows = table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    df = drain_in_pieces(rows, "ts", lambda x: sessions_stream(x, "ts", "user_id", "4 hours"))
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_at", "last_at")})


@query("stream_sliding_counts", """
WITH w AS (SELECT event_type AS key, time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start FROM events, (VALUES (0), (1), (2), (3)) v(k))
SELECT key, start, count(*) AS n FROM w WHERE start + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2""")
def _(s, d):
    from tidewire.streaming.queries import drain_in_pieces, sliding_counts_stream

    rows = table(s, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    df = drain_in_pieces(rows, "ts", lambda x: sliding_counts_stream(x, "ts", "event_type", "24 hours", "6 hours"))
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("sql_fingerprints", SQL["fingerprint_groups"])
def _(s, d):
    """As ``fingerprint_groups``, in SQL alone."""
    register_sql(s)
    table(s, d, "documents").createOrReplaceTempView("tidewire_documents")
    return s.sql("""
        SELECT fingerprint_of(coalesce(text, '')) AS fingerprint, count(*) AS n, min(doc_id) AS first_key
        FROM tidewire_documents GROUP BY 1 HAVING count(*) > 1""")


@query("novelty_decay", """
WITH c AS (SELECT event_id, user_id, value, epoch_us(ts) // 1000 AS ms, row_number() OVER w AS k, first_value(epoch_us(ts) // 1000) OVER w AS began FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
v AS (SELECT event_id, k, 100 - least(70.0, (k - 1) * 18.0) - least(20.0, greatest(0.0, (ms - began) / 60000.0) * 0.25) + greatest(0.0, (1 - (event_id % 101) / 100.0) * 30) AS raw FROM c)
SELECT event_id, round(CASE WHEN k = 1 THEN 100.0 ELSE least(100.0, greatest(0.0, raw)) END, 4) AS novelty FROM v""")
def _(s, d):
    """A user's events as posts on one story: of so many sources before, so long after the first, and so alike."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    df = table(s, d, "events").select("event_id", ms.alias("ms"), F.first(ms).over(order).alias("began"), F.row_number().over(order).alias("k"))
    value = score.novelty(F.col("k") - 1, (F.col("ms") - F.col("began")) / 60_000.0, (F.col("event_id") % 101) / 100.0, F.col("k") == 1)
    return df.select("event_id", r4(value).alias("novelty"))


@query("events_per_minute", f"""
SELECT count_if(event_type = 'purchase') AS published, round(count_if(event_type = 'purchase') / 720.0, 3) AS events_per_minute FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY""")
def _(s, d):
    return reports.events_per_minute(table(s, d, "events"), "ts", ts("2024-01-30 00:00:00"), ts(NOW), F.col("event_type") == "purchase")


@query("allowed_messages", r"""
WITH c AS (SELECT source AS channel_id, CASE WHEN min(doc_id) % 2 = 0 THEN [lang || ' desk' FOR lang IN list_sort(list(DISTINCT lang))][1:2] END AS authors FROM documents GROUP BY source)
SELECT doc_id AS id, source AS channel_id, upper(lang) || ' Desk#' || (doc_id % 10000) AS author FROM documents JOIN c ON c.channel_id = source
WHERE authors IS NULL OR len(authors) = 0 OR list_contains(authors, lower(lang) || ' desk')""")
def _(s, d):
    """Documents as messages of their source's channel; half of the channels take the first two languages only."""
    docs = table(s, d, "documents")
    few = F.slice(F.transform(F.array_sort(F.collect_set("lang")), lambda x: F.concat(x, F.lit(" desk"))), 1, 2)
    channels = docs.groupBy(F.col("source").alias("channel_id")).agg(F.when(F.min("doc_id") % 2 == 0, few).alias("authors"))
    author = F.concat(F.upper("lang"), F.lit(" Desk#"), (F.col("doc_id") % 10000).cast("string"))
    messages = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("channel_id"), author.alias("author"))
    return feeds.allowed(messages, channels).select("id", "channel_id", "author")


@query("resolved_posts", r"""
WITH p AS (SELECT doc_id, doc_id % 997 AS post_id FROM documents),
s AS (SELECT doc_id % 499 AS post_id, arg_max(text, length(text)) AS text FROM documents WHERE doc_id % 3 = 0 AND trim(coalesce(text, '')) <> '' GROUP BY 1),
r AS (SELECT doc_id % 811 AS post_id, max(length(text)) AS n FROM documents WHERE doc_id % 3 = 1 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 12 GROUP BY 1)
SELECT p.doc_id, CASE WHEN s.post_id IS NOT NULL THEN 'stored' WHEN r.post_id IS NOT NULL THEN 'relay' END AS resolved_by, CAST(coalesce(length(s.text), r.n) AS INTEGER) AS n_chars
FROM p LEFT JOIN s USING (post_id) LEFT JOIN r USING (post_id)""")
def _(s, d):
    """Posts known by an id, whose text is that of stored or relayed documents; texts are compared by length, as the longest are taken."""
    docs, key = table(s, d, "documents"), F.col("doc_id")
    known = lambda of, rest: docs.where(key % 3 == rest).select((key % of).alias("post_id"), "text", F.lit(None).cast("timestamp").alias("published_at"))
    rows = relay.resolve(docs.select("doc_id", (key % 997).alias("post_id")), known(499, 0), known(811, 1))
    return rows.select("doc_id", "resolved_by", F.length("text").alias("n_chars"))


@query("publication_times", """
SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN make_timestamp(2026, 5, CAST(doc_id % 28 + 1 AS INTEGER), 1, 2, 3) END, CASE WHEN doc_id % 5 = 0 THEN make_timestamp(2026, 4, CAST(doc_id % 28 + 1 AS INTEGER), 4, 5, 6) END,
  CASE WHEN doc_id % 7 > 0 THEN make_timestamp(2026, 3, CAST(doc_id % 28 + 1 AS INTEGER), 7, 8, 9) END) AS published_at FROM documents""")
def _(s, d):
    key = F.col("doc_id")
    at = lambda month, clock: F.format_string(f"2026-{month:02}-%02dT{clock}Z", key % 28 + 1)
    embed, origin = F.when(key % 3 == 0, at(5, "01:02:03")).otherwise("soon"), F.when(key % 5 == 0, at(4, "04:05:06"))
    message = F.when(key % 7 > 0, at(3, "07:08:09"))
    df = table(s, d, "documents").select("doc_id", relay.publication_time(embed, origin, message).alias("published_at"))
    return df.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("text_chunks", """
SELECT doc_id, length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) AS n_chars, true AS fits FROM documents""")
def _(s, d):
    """Whole texts in messages of at most 2,000 characters: none is longer, and nothing but white space is lost."""
    text = F.coalesce("text", F.lit(""))
    parts = render.chunks(text, 2000)
    bare = F.regexp_replace(F.array_join(parts, ""), "\\s+", "")
    fits = F.forall(parts, lambda p: F.length(p) <= 2000) & (bare == F.regexp_replace(text, "\\s+", ""))
    return table(s, d, "documents").select("doc_id", F.length(bare).alias("n_chars"), fits.alias("fits"))


@query("security_master", """
SELECT 'T' || p_partkey AS ticker, p_name || ', "' || p_brand || '"' AS name, len(string_split(p_name, ' ')) AS n_aliases, CASE WHEN p_size % 3 = 0 THEN 'safe' ELSE 'ambiguous' END AS ambiguity,
  CAST(CASE WHEN p_size % 5 = 0 THEN 50 ELSE p_size END AS INTEGER) AS priority FROM part""")
def _(s, d):
    """Parts written as a file of securities, with quotes and commas in their names, and read back."""
    from tidewire.sources.shared import work_dir

    path = f"{work_dir(s)}/securities"
    rows = table(s, d, "part").select(
        F.format_string("t%d", "p_partkey").alias("ticker"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("name"), F.replace("p_name", F.lit(" "), F.lit("|")).alias("aliases"),
        F.lit("NYSE").alias("exchange"), F.when(F.col("p_size") % 3 == 0, "safe").alias("ambiguity"), F.lit("SPX|NDX").alias("indices"), F.lit(None).cast("string").alias("sector"),
        F.when(F.col("p_size") % 5 > 0, F.col("p_size")).alias("priority"),
    )
    rows.write.csv(path, header=True, quote='"', escape='"')
    return feeds.read_securities(s, path).select("ticker", "name", F.size("aliases").alias("n_aliases"), "ambiguity", "priority")


@query("replayed_posts")
def _(s, d):
    """Stored posts put through today's classifier again: how each verdict of a lexicon without its noise words and with one category less fares now."""
    rows = _posts(s, d)
    sources = rows.select("source_id").distinct().select(
        "source_id", F.lit(True).alias("enabled"), F.lit("rss").alias("source_type"), F.lit(90.0).alias("quality_score"), F.lit(5.0).alias("noise_score"),
        F.lit(False).alias("official"), F.lit("standard").alias("filter_profile"), F.lit("ECONOMIC").alias("category"),
    )
    earlier = dataclasses.replace(SAMPLE, noise={}, categories=SAMPLE.categories[:-1])
    # Both know the same securities and names.
    rows = P.assessed(P.prepared(rows, sources, SAMPLE), [earlier, SAMPLE])
    stored, again = (written(P.judged(rows, i).select("id", "status", "rejection_reason")) for i in (0, 1))
    return desk.verdict_changes(stored, again)


@query("replay_report", f"""
SELECT count(*) AS candidates, count_if(result = 'READY') AS ready, count_if(result = 'SKIPPED') AS skipped,
  count_if(result = 'SKIPPED' AND reason = 'unknown') AS skipped_unknown_time, count_if(result = 'UNRESOLVABLE') AS unresolvable FROM ({SQL["delivery_replay"]})""")
def _(s, d):
    return replay.replay_report(QUERIES["delivery_replay"](s, d))
