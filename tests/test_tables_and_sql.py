"""Sketches, bucketed tables, session windows and the SQL functions."""

from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.functions.sql_surface import Chunks, register_sql
from tidewire.operators import buckets, merge, sketches
from tidewire.streaming import queries as S

T0 = datetime(2024, 3, 1)


def test_sketches_merge_to_within_their_error(spark):
    r = np.random.default_rng(1)
    values = r.lognormal(3, 1, 20_000)
    rows = [(T0 + timedelta(minutes=int(i % 1440)), "ab"[int(i % 2)], float(v), int(m)) for i, (v, m) in enumerate(zip(values, r.integers(0, 3000, 20_000)))] + [(T0, "a", None, None)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string, value double, user int").repartition(7)
    stored = sketches.hourly_sketches(df, "ts", ["kind"], "value", "user").cache()
    assert stored.count() == 48
    low, high = T0 + timedelta(hours=3), T0 + timedelta(hours=17)
    got = {x.kind: x for x in sketches.percentile_range(stored, ["kind"], [0.1, 0.5, 0.99], F.lit(low), F.lit(high)).collect()}
    users = {x.kind: x.members for x in sketches.distinct_range(stored, ["kind"], F.lit(low), F.lit(high)).collect()}
    for kind in "ab":
        mine = [x for x in rows if x[1] == kind and low <= x[0] < high and x[2] is not None]
        ranks = np.array([x[2] for x in mine])
        for p, name in ((0.1, "p10"), (0.5, "p50"), (0.99, "p99")):
            assert abs((ranks <= got[kind][name]).mean() - p) < 0.02
        exact = len({x[3] for x in mine})
        assert got[kind].n == len(mine) and abs(users[kind] - exact) < 0.05 * exact
    assert sketches.percentile_range(stored, ["kind"], [0.5]).agg(F.sum("n")).first()[0] == len(rows)
    assert sketches.percentile_range(stored.limit(0), ["kind"], [0.5]).count() == 0


def files_of(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_an_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(i, f"v{i}", None if i % 3 else "known", 0) for i in range(500)] + [(7, "older", "x", -1), (None, "null key", None, 0)], "id int, name string, hash string, version int")
    buckets.create_table(rows, path, ["id"], "version", ["hash"], 16)
    before = files_of(tmp_path / "t")
    change = spark.createDataFrame([(3, "new", "", 1), (3, "newest", None, 2), (9000, "added", None, 1), (None, "null again", "h", 1)], "id int, name string, hash string, version int")
    touched = buckets.upsert_table(spark, path, change, ["id"], "version", ["hash"], 16)
    after = files_of(tmp_path / "t")
    kept = {p for p in before if p in after}
    assert 1 <= len(touched) <= 3 and {int(Path(p).parent.name.partition("=")[2]) for p in set(before) - kept} == set(touched) and len(kept) == 16 - len(touched)
    assert all(before[p] == after[p] for p in kept)
    read = lambda df: sorted((tuple(r) for r in df.select("id", "name", "hash", "version").collect()), key=repr)
    want = merge.upsert(merge.upsert(rows, rows.limit(0), ["id"], "version", ["hash"]), change, ["id"], "version", ["hash"])
    got = read(spark.read.parquet(path))
    assert got == read(want) and (3, "newest", "known", 2) in got and (None, "null again", "h", 1) in got and len(got) == 502
    assert buckets.upsert_table(spark, path, change.limit(0), ["id"], "version", ["hash"], 16) == [] and files_of(tmp_path / "t") == after
    plan = spark.read.parquet(path).where(F.col("bucket").isin(touched))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:60]


def test_retention_drops_days_and_touches_no_others(spark, tmp_path):
    path = f"file://{tmp_path}/days"
    buckets.create_daily(spark.createDataFrame([(i, T0 + timedelta(hours=7 * i)) for i in range(30)], "id int, ts timestamp"), path, "ts")
    before = files_of(tmp_path / "days")
    assert buckets.drop_days(spark, path, "2024-03-05") == [f"2024-03-0{d}" for d in (1, 2, 3, 4)]
    after = files_of(tmp_path / "days")
    assert set(after) < set(before) and all(before[p] == t for p, t in after.items())
    assert spark.read.parquet(path).agg(F.min("ts")).first()[0] >= datetime(2024, 3, 5)
    assert buckets.drop_days(spark, path, "2024-03-05") == []


def test_sessions_meet_across_batches(spark):
    at = [0, 10, 100, 115, 300, 125, 900]
    df = spark.createDataFrame([("k", T0 + timedelta(minutes=m)) for m in at] + [("z", T0 + timedelta(minutes=2000))], "user string, ts timestamp")
    for pieces in (1, 5):
        got = S.drain_in_pieces(df, "ts", lambda s: S.sessions_stream(s, "ts", "user", "30 minutes"), pieces).collect()
        assert sorted(((r.first_at - T0).seconds // 60, (r.last_at - T0).seconds // 60, r.n) for r in got) == [(0, 10, 2), (100, 125, 3), (300, 300, 1), (900, 900, 1)]
    # Two sessions, one in each batch, that an event between them makes one.
    path = S.work_dir(spark)
    job = lambda: S.sessions_stream(spark.readStream.schema(df.schema).parquet(f"{path}/in"), "ts", "user", "30 minutes", "2 hours")
    for batch in ([0, 50], [25, 1000]):
        spark.createDataFrame([("k", T0 + timedelta(minutes=m)) for m in batch], df.schema).write.mode("append").parquet(f"{path}/in")
        got = S.drain(job(), path, spark).collect()
    assert [((r.last_at - r.first_at).seconds // 60, r.n) for r in got] == [(50, 3)]


def test_sql_functions_are_the_expressions(spark):
    names = register_sql(spark)
    rows = ["Fed's hike: 0.25% by J.P.-Morgan’s desk", "  a   b\t", "", None, "O'Neil it's", "U.S.-China 1,200 e-mail", "the of and"]
    spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string").createOrReplaceTempView("odd_texts")
    got = spark.sql("""
        SELECT tidy_text(text) AS tidy, tokens_of(text) AS tokens, significant_tokens(tokens_of(text)) AS words, fingerprint_of(text) AS fingerprint,
          jaccard_of(tokens_of(text), array('fed', 'by')) AS alike, hash_similarity(i, 7) AS bits FROM odd_texts ORDER BY i""").collect()
    c = F.col("text")
    want = spark.table("odd_texts").orderBy("i").select(
        X.normalize_whitespace(c), X.tokenize(c), X.significant(X.tokenize(c)), X.fingerprint(X.tokenize(c)), X.jaccard(X.tokenize(c), F.array(F.lit("fed"), F.lit("by"))),
        X.simhash_similarity(F.col("i").cast("long"), F.lit(7).cast("long")),
    ).collect()
    assert [tuple(g) for g in got] == [tuple(w) for w in want] and "text_chunks" in names
    plan = spark.sql("SELECT fingerprint_of(text) FROM odd_texts")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chunks_joined_laterally(spark):
    register_sql(spark)
    text = "one two three\n four " + "x" * 25 + " end"
    spark.createDataFrame([(1, text), (2, None), (3, "  ")], "i int, text string").createOrReplaceTempView("long_texts")
    got = [tuple(r) for r in spark.sql("SELECT i, c.place, c.piece FROM long_texts, LATERAL text_chunks(text, 10) c ORDER BY i, place").collect()]
    assert got == [(1, 0, "one two"), (1, 1, "three"), (1, 2, "four"), (1, 3, "x" * 10), (1, 4, "x" * 10), (1, 5, "xxxxx end")]
    assert [p for _, p in Chunks().eval("word " * 5000, 2000)][0].count("word") == 400
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT * FROM long_texts, LATERAL text_chunks(text, i)").collect()
