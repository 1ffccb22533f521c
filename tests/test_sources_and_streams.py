import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewire.sources import feeds
from tidewire.streaming import queries as S

RSS = """<rss><channel><title>t</title><item><title>Fed &amp; ECB act</title><link>http://a.com/1</link><guid isPermaLink="false">g1</guid>
<pubDate>Thu, 28 May 2026 12:00:00 GMT</pubDate><description>&lt;p&gt;Rates up&lt;/p&gt;</description></item><item><title>Undated</title><link>http://a.com/2</link></item></channel></rss>"""
ATOM = """<feed><title>f</title><entry><title>Entry</title><id>e1</id><updated>2026-05-28T12:00:00Z</updated><link href="http://b.com/1" rel="alternate"/><summary>Sum</summary></entry></feed>"""


def test_feeds(spark):
    df = spark.createDataFrame([("rss", RSS), ("atom", ATOM), ("bad", "<rss><chan")], "source_id string, xml string")
    got = {r.source_post_id: r for r in feeds.parse_feed(df).collect()}
    assert set(got) == {"g1", "http://a.com/2", "e1"}
    assert got["g1"].text == "Fed & ECB act — Rates up" and got["g1"].published_at == datetime(2026, 5, 28, 12)
    assert got["http://a.com/2"].published_at is None and got["e1"].url == "http://b.com/1"
    kinds = {r.source_id: r.kind for r in feeds.summarize_feeds(feeds.parse_feed(df), F.lit("2026-05-28 13:00:00").cast("timestamp")).collect()}
    assert kinds == {"rss": "usable", "atom": "usable"}


def test_filings(spark):
    df = spark.createDataFrame([("8-K - NVIDIA CORP (0001045810) (Filer)", "https://sec.gov/x/0001045810-26-000012-index.htm")], "t string, u string")
    r = df.select(feeds.filing_title(F.col("t")).alias("f"), feeds.accession(F.col("u")).alias("a")).first()
    assert tuple(r.f) == ("8-K", "NVIDIA CORP", "0001045810") and r.a == "0001045810-26-000012"


def test_chat(spark):
    good = {"version": 1, "id": "1", "channel_id": "c", "author": "Ann#1234", "content": "hello", "embeds": [{"title": "T", "fields": [{"name": "n", "value": "v"}]}]}
    df = spark.createDataFrame([(json.dumps(good),), ("{broken",), (json.dumps({"version": 2, "id": "2", "content": "x"}),), (json.dumps({"version": 1, "id": "3"}),)], "payload string")
    rows = feeds.parse_chat(df).collect()
    assert [r.reject_reason for r in rows] == [None, "malformed", "version", "empty"] and rows[0].text == "hello\n\nT\n\nn: v"
    channels = spark.createDataFrame([("c", ["ann"])], "channel_id string, authors array<string>")
    assert feeds.allowed(feeds.parse_chat(df), channels).count() == 1


def test_securities(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('ticker,name,aliases,exchange,ambiguity,indices,sector,priority\n# note\naapl,"Apple, Inc.",Apple|AAPL Inc,NASDAQ,safe,SPX|NDX,Tech,90\nX,US Steel,,NYSE,,,Metals,\n')
    got = {r.ticker: r for r in feeds.read_securities(spark, f"file://{path}").collect()}
    assert got["AAPL"].name == "Apple, Inc." and got["AAPL"].indices == ["SPX", "NDX"] and (got["X"].ambiguity, got["X"].priority) == ("ambiguous", 50)


def stream(spark, tmp_path, df, name):
    path = f"file://{tmp_path}/{name}"
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_streams(spark, tmp_path):
    t = datetime(2026, 1, 1)
    polls = spark.createDataFrame([("a", t + timedelta(minutes=i), i not in (1, 2, 3)) for i in range(5)] + [("b", t, True)], "source_id string, ts timestamp, ok boolean").coalesce(1)
    got = S.drain(S.health_stream(stream(spark, tmp_path, polls, "polls")), f"file://{tmp_path}/h", spark).orderBy("ts").collect()
    assert [(r.source_id, r.state) for r in got] == [("a", "ERROR"), ("a", "DISCONNECTED"), ("a", "ACTIVE")]
    rows = spark.createDataFrame([(1, "k", t), (2, "k", t + timedelta(minutes=30)), (3, "k", t + timedelta(minutes=200)), (1, "k", t)], "id int, key string, ts timestamp")
    landed = S.drain(S.land_stream(stream(spark, tmp_path, rows, "rows"), ("id",), "ts"), f"file://{tmp_path}/l", spark)
    assert sorted(r.id for r in landed.collect()) == [1, 2, 3]
    pairs = S.drain(S.recent_duplicates_stream(stream(spark, tmp_path, rows.dropDuplicates(["id"]), "twins"), "key", "ts"), f"file://{tmp_path}/d", spark)
    assert [(r.id, r.earlier_id) for r in pairs.collect()] == [(2, 1)]
