"""Streams with state of their own, stopped and started again, against batches and plain versions."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from test_posts import POSTS, STREAMS, T0, clusters_post_by_post, told

from tidewire.operators import cluster
from tidewire.sources import polls
from tidewire.streaming import ledger
from tidewire.streaming import queries as S
from tidewire.streaming.clusters import cluster_stream
from tidewire.streaming.stateful import health_timers_stream, new_items_stream, retries_stream


@pytest.mark.parametrize("pieces", [1, 4])
def test_clusters_of_a_stream_are_those_of_a_batch(spark, pieces):
    rows = STREAMS["dense"]()
    df = spark.createDataFrame(rows, POSTS)
    want = clusters_post_by_post(rows, {r.id: r for r in cluster.prepare(df).collect()})
    assert told(S.drain_in_pieces(df, "ts", cluster_stream, pieces).collect()) == want


# ---------------------------------------------------------------- polls


def document(*items):
    return "<rss><channel><title>t</title>" + "".join(f"<item><title>{i}</title><guid>{i}</guid><pubDate>Thu, 28 May 2026 12:00:00 GMT</pubDate></item>" for i in items) + "</channel></rss>"


def at(minute):
    return T0 + timedelta(minutes=minute)


def written_polls(spark, path, rows):
    polls.write_polls(spark.createDataFrame([(s, at(m), x, e) for s, m, x, e in rows], "source_id string, polled_at timestamp, xml string, error string"), path)


FIRST = [("a", 0, document("x", "y"), None), ("a", 1, document("x", "y"), None), ("a", 2, None, "HTTP 404"), ("a", 3, document("x", "y"), None), ("b/ü", 0, "", None), ("b/ü", 5, "<html>no</html>", None)]
LATER = [("a", 4, document("z"), None), ("b/ü", 2, document("late"), None), ("b/ü", 6, "<feed><entry><id>e</id><title>t</title></entry></feed>", None), ("c", 1, document(), None), ("a", 5, document("z"), None)]


def test_polls_of_feeds_by_batch_and_stream(spark, tmp_path):
    polls.register(spark)
    path, out = f"file://{tmp_path}/feeds", f"file://{tmp_path}/run"
    read = lambda: spark.read.format("feed_polls").load(path)
    assert read().count() == 0
    written_polls(spark, path, FIRST)
    (tmp_path / "feeds" / "a" / "notes.txt").write_text("not a poll")

    def rows(df):
        return sorted((r.source_id, r.polled_at, r.ok, r.quiet, r["items"], r.error) for r in df.collect())

    want = [("a", at(0), True, False, 2, None), ("a", at(1), True, True, 0, None), ("a", at(2), False, False, 0, "HTTP 404"), ("a", at(3), True, True, 0, None),
            ("b/ü", at(0), True, True, 0, None), ("b/ü", at(5), False, False, 0, "not a feed")]
    assert rows(polls.outcomes(read())) == want
    stream = lambda: polls.outcomes(spark.readStream.format("feed_polls").load(path))
    assert rows(S.drain(stream(), out, spark)) == want
    # A poll of b that turns up behind the offset of b is not taken up; the other feeds go on by themselves.
    written_polls(spark, path, LATER)
    more = [("a", at(4), True, False, 1, None), ("a", at(5), True, True, 0, None), ("b/ü", at(6), True, False, 1, None), ("c", at(1), True, False, 0, None)]
    assert rows(S.drain(stream(), out, spark)) == sorted(want + more)
    assert rows(S.drain(stream(), out, spark)) == sorted(want + more)
    assert sorted((r.source_id, r.source_post_id, r.polled_at) for r in polls.polled_items(read()).collect()) == [
        ("a", "x", at(0)), ("a", "y", at(0)), ("a", "z", at(4)), ("b/ü", "e", at(6)), ("b/ü", "late", at(2))]


def test_polls_are_read_alike_in_any_partitions(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/feeds"
    written_polls(spark, path, FIRST + LATER)
    reader = polls.PollReader(path, StructType.fromDDL(polls.SCHEMA))
    read = lambda: [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    whole = read()
    monkeypatch.setattr(polls, "POLLS", 1)
    monkeypatch.setattr(polls, "ROWS", 1)
    assert read() == whole and len(whole) == 11


# ---------------------------------------------------------------- new items


def plain_new_items(rows, most):
    """Feed by feed and poll by poll, as a poller would keep them."""
    out, by = [], {}
    for source, item, polled, place, published in rows:
        by.setdefault((source, polled), []).append((place, item, published))
    seen, newest = {}, {}
    for (source, polled), poll in sorted(by.items()):
        known, first, before = seen.setdefault(source, []), source not in newest, newest.get(source)
        fresh = []
        for _, item, published in sorted(poll, key=lambda x: x[0]):
            if item in known or (not first and published is not None and published < before):
                continue
            known.append(item)
            fresh.append((source, item, polled, published))
        fresh.sort(key=lambda r: r[3] or r[2]) if first else None
        if first:
            fresh = [r for r in fresh if r[3] is None or r[2] - r[3] <= timedelta(minutes=15)][-5:]
        out += [(s, i) + ((p - datetime(1970, 1, 1)) // timedelta(milliseconds=1),) for s, i, p, _ in fresh]
        newest[source] = max([before or datetime(1970, 1, 1)] + [p for _, _, p in poll if p])
        del known[:-most]
    return sorted(out)


@pytest.mark.parametrize("most, pieces", [(400, 1), (6, 3)])
def test_new_items_against_a_poller(spark, most, pieces):
    r = np.random.default_rng(1)
    rows = []
    for poll in range(30):
        for source in "ab":
            for place in range(int(r.integers(0, 12))):
                n = int(r.integers(max(0, poll * 4 - 20), poll * 4 + 8))
                rows.append((source, f"i{n}", at(poll * 10), place, None if n % 9 == 0 else at(n * 2 + int(r.integers(-30, 1)) // 4 * 4 + 8)))
    df = spark.createDataFrame(rows, "source_id string, item_id string, polled_at timestamp, place int, published_at timestamp")
    got = S.drain_in_pieces(df, "polled_at", lambda s: new_items_stream(s, seen=most), pieces).collect()
    assert sorted((x.source_id, x.item_id, x.polled_ms) for x in got) == plain_new_items(rows, most)


# ---------------------------------------------------------------- health and retries


@pytest.mark.parametrize("pieces", [1, 3])
def test_health_told_by_timers_is_that_of_every_tick(spark, pieces):
    r = np.random.default_rng(4)
    rows, minute = [], 0
    for i in range(60):
        minute += int(r.choice([1, 5, 20, 50, 90]))
        rows.append(("ab"[int(r.integers(0, 2))], at(minute), bool(r.random() > 0.3), int(r.integers(0, 2))))
    df = spark.createDataFrame([*rows, ("end", at(minute + 600), True, 1)], "source_id string, ts timestamp, ok boolean, items int")
    got = S.drain_in_pieces(df, "ts", health_timers_stream, pieces).where("source_id <> 'end'").orderBy("source_id", "at_ms").collect()
    epoch = datetime(1970, 1, 1)
    want = []
    for source in "ab":
        mine = [x for x in rows if x[0] == source]
        state = "ACTIVE"
        # Every minute, and a millisecond after it, until well after the last poll.
        for tick in (at(m) + timedelta(milliseconds=e) for m in range(minute + 500) for e in (0, 1)):
            past = [x for x in mine if x[1] <= tick]
            failures = next((k for k, x in enumerate(reversed(past)) if x[2]), len(past))
            items = [x[1] for x in past if x[3]]
            if not past:
                continue
            since = (tick - items[-1]) if items else None
            if failures:
                now = "DISCONNECTED" if failures >= 3 else "ERROR"
            else:
                now = "STALE" if since is None or since > timedelta(minutes=45) else "DELAYED" if since > timedelta(minutes=15) else "ACTIVE"
            if now != state:
                state = now
                want.append((source, (tick - epoch) // timedelta(milliseconds=1), now, failures))
    assert [tuple(x) for x in got] == want and {"STALE", "DELAYED", "ERROR", "ACTIVE"} <= {w[2] for w in want}


def second(s):
    return T0 + timedelta(seconds=s)


@pytest.mark.parametrize("pieces", [1, 4])
def test_retries_wait_and_end(spark, pieces):
    rows = [
        ("done", 0, 0, "queued"), ("done", 1, 1, "failed"), ("done", 3, 2, "ok"), ("done", 4, 3, "failed"), ("done", 5, 4, "queued"),
        ("bad", 0, 0, "queued"), ("bad", 1, 1, "failed"), ("bad", 2, 2, "failed"), ("bad", 6, 3, "failed"), ("bad", 17, 4, "failed"), ("bad", 18, 5, "queued"), ("bad", 18, 6, "ok"),
        ("hung", 0, 0, "queued"), ("twice", 0, 0, "queued"), ("twice", 1, 1, "queued"), ("end", 9000, 0, "queued"),
    ]
    df = spark.createDataFrame([(j, second(s), p, k) for j, s, p, k in rows], "job_id string, ts timestamp, place int, kind string")
    got = {}
    for r in S.drain_in_pieces(df, "ts", retries_stream, pieces).collect():
        got.setdefault(r.job_id, []).append(((r.at_ms - int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000)) / 1000, r.attempt, r.action))
    got = {k: sorted(v) for k, v in got.items()}
    assert got["done"][:5] == [(0, 1, "RUN"), (1, 1, "FAILED"), (2, 2, "RUN"), (3, 2, "DONE"), (5, 1, "RUN")]
    assert got["bad"] == [(0, 1, "RUN"), (1, 1, "FAILED"), (2, 2, "FAILED"), (2, 2, "RUN"), (5, 3, "RUN"), (6, 3, "FAILED"), (16, 4, "RUN"), (17, 4, "FAILED"), (17, 4, "GIVEN_UP"), (18, 1, "DONE"), (18, 1, "RUN")]
    assert got["hung"] == got["twice"] == sorted([(0, 1, "RUN"), (600, 1, "STUCK"), (601, 2, "RUN"), (1201, 2, "STUCK"), (1204, 3, "RUN"), (1804, 3, "STUCK"), (1814, 4, "RUN"), (2414, 4, "STUCK"), (2414, 4, "GIVEN_UP")])


# ---------------------------------------------------------------- the ledger


def test_a_batch_that_fails_is_delivered_once(spark, tmp_path):
    source, out, check = f"file://{tmp_path}/in", f"file://{tmp_path}/ledger", f"file://{tmp_path}/check"
    payloads = lambda lo, hi: spark.createDataFrame([(f"e{i}", f'{{"n": {i}}}') for i in range(lo, hi)], "event_id string, payload string")
    payloads(0, 40).repartition(8).write.parquet(source)
    stream = lambda: spark.readStream.schema("event_id string, payload string").option("maxFilesPerTrigger", 4).parquet(source)
    flag = tmp_path / "failed"

    @F.udf("string")
    def broken(event, payload):
        if event == "e30" and not flag.exists():
            flag.write_text("")
            raise RuntimeError("half way")
        return payload

    with pytest.raises(Exception, match="half way"):
        ledger.deliver(stream().withColumn("payload", broken("event_id", "payload")), out, check).awaitTermination()
    ledger.deliver(stream().withColumn("payload", broken("event_id", "payload")), out, check).awaitTermination()
    assert sorted(r.event_id for r in ledger.delivered(spark, out).collect()) == sorted(f"e{i}" for i in range(40))
    # The entry was written, but the stream died before it knew: the batch is run again and changes nothing.
    last = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (tmp_path / "check" / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    ledger.deliver(stream(), out, check).awaitTermination()
    payloads(35, 45).write.mode("append").parquet(source)
    ledger.deliver(stream(), out, check).awaitTermination()
    got = {r.event_id: (r.payload, r.batch) for r in ledger.delivered(spark, out).collect()}
    assert {k: v[0] for k, v in got.items()} == {f"e{i}": f'{{"n": {i}}}' for i in range(45)} and len({b for _, b in got.values()}) == 3
    listed = [f for e in (tmp_path / "ledger" / "entries").glob("*.json") for f in json.loads(e.read_text())["files"]]
    rows = [json.loads(x)["event_id"] for f in listed for x in (tmp_path / "ledger" / "payloads" / f).read_text().splitlines()]
    assert len(rows) == 50


def test_states_are_fed_rows_not_frames(spark, tmp_path):
    """A data frame a key costs more than the few rows of most keys."""
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1), True, 1)], "source_id string, ts timestamp, ok boolean, items int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = health_timers_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    assert "InPandas" not in stream._jdf.queryExecution().analyzed().toString()
