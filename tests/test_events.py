"""Earnings, market impact, provenance, replay, relayed messages and the reports on them."""

import datetime as dt

from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.functions.register import register
from tidewire.operators import earnings, impact, provenance, replay, reports
from tidewire.operators.extract import Security
from tidewire.sources import feeds, relay


def at(text):
    return F.lit(text).cast("timestamp")


def one(spark, value, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return row.select(value.alias("x")).first().x


EARNINGS = [
    ("APPLE Q3 EPS $2.40 VS $2.35 EST", dict(eps=2.40, eps_consensus=2.35, eps_surprise="BEAT", period="Q3")),
    ("Q3 EPS $(0.15) vs $(0.10) est", dict(eps=-0.15, eps_consensus=-0.10, eps_surprise="MISS")),
    ("Reports Q2 2025 revenue of $4.5 billion vs. est. 4.5bn", dict(revenue=4.5e9, revenue_consensus=4.5e9, revenue_surprise="INLINE", period="Q2 2025")),
    ("Quarterly results: gross margin was 41.5%, buyback of $2bn; raises full-year guidance to $9", dict(gross_margin=41.5, buybacks=2e9, guidance="raises full-year guidance to $9")),
    ("EPS 1.10", dict(eps=1.1, eps_consensus=None, eps_surprise=None)),
    ("ACME will report EPS next week", None), ("nothing of the kind", None), ("", None), (None, None),
]


def test_earnings(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EARNINGS)], "i int, t string")
    got = {r.i: r.earnings for r in earnings.with_earnings(df, "t").collect()}
    for i, (_, want) in enumerate(EARNINGS):
        assert (got[i] is None) if want is None else {k: got[i][k] for k in want} == want


def test_earnings_headline(spark):
    df = spark.createDataFrame([("Q3 EPS $2.40 VS $2.35 EST", "Apple"), ("EPS -1.10", "Acme"), ("EPS 1.10", None), ("no figures", "x")], "t string, s string")
    e = earnings.with_earnings(df, "t", "e")
    got = [r.x for r in e.select(earnings.earnings_headline(F.col("e"), F.col("s"), F.col("t")).alias("x")).collect()]
    assert got == ["APPLE Q3 EPS ABOVE EXPECTATIONS", "ACME REPORTS EPS -$1.10", "EPS 1.10", "no figures"]


def test_impact(spark):
    rows = [
        (1, "FED HOLDS", "FED", None, "HIGH", [], [], []),
        (2, "ACME TO ACQUIRE BETA", "EQUITY", None, "MODERATE", ["ACME"], [], []),
        (3, "ACME BUYS BACK SHARES", "EQUITY", None, "MODERATE", ["ACME"], [], []),
        (4, "AAPL SLIPS", "EQUITY", None, "HIGH", ["AAPL"], [], []),
        (5, "4:03 PM - ** a ** tariff", "FED", None, "CRITICAL", [], [], []),
        (6, "WHEAT", "COMMODITY", None, "HIGH", None, None, ["WHEAT"]),
        (7, "PIPELINE SHUT", "COMMODITY", None, "LOW", [], [], ["CRUDE"]),
        (8, None, None, None, "CRITICAL", None, None, None),
    ]
    schema = "id long, text string, category string, subcategory string, band string, tickers array<string>, countries array<string>, commodities array<string>"
    master = spark.createDataFrame([("AAPL", ["SPX"], 95), ("ACME", ["SPX"], 50)], "ticker string, indices array<string>, priority int")
    df = impact.movers(spark.createDataFrame(rows, schema), master)
    n = F.size(F.coalesce("tickers", F.array().cast("array<string>")))
    v = impact.assess_impact(F.col("text"), F.col("category"), F.col("subcategory"), F.col("band"), n, F.col("has_mover"), F.col("countries"), F.col("commodities"))
    got = {r.id: (r.v.relevance, r.v.market_moving) for r in df.select("id", v.alias("v")).collect()}
    assert got == {
        1: ("broad", True), 2: ("single_name", True), 3: ("single_name", False), 4: ("broad", True), 5: ("none", False),
        6: ("sector", True), 7: ("broad", False), 8: ("none", True),
    }


def test_provenance(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    cols = "event long, source_id string, source_name string, org string, author string, origin_author string, origin_channel string, carrier string, preserved boolean, publisher string, publisher_org string, first_seen_at timestamp"
    rows = [
        (1, "x:fed", "Fed", "fed", "@fed", None, None, None, None, None, None, t(5)),
        (1, "rss:fed", "Fed RSS", "fed", None, None, None, None, None, None, None, t(3)),
        (1, "discord:a", "Chan", None, None, "walter", "wire", "bot", True, None, None, t(4)),
        (1, "discord:b", "Chan", None, "bot", None, None, "bot", False, None, None, None),
        (2, "finnhub:general", "Agg", "agg", None, None, None, None, None, "Reuters", "reuters", t(1)),
        (2, "finnhub:general", "Agg", "agg", None, None, None, None, None, "Reuters", "reuters", t(0)),
    ]
    df = provenance.attribute(spark.createDataFrame(rows, cols))
    got = {r.event: r for r in provenance.provenance_of(df, "event").collect()}
    assert (got[1].origins, got[1].label) == ("x,discord,rss", "Fed RSS + walter + @fed + unattributed via bot")
    assert (got[1].confirmed_by, got[1].corroborated, got[1].first_reported_at) == (3, True, t(3))
    assert (got[2].origins, got[2].label, got[2].confirmed_by, got[2].first_reported_at) == ("wire", "Reuters", 1, t(0))


def test_replay(spark):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    deliveries = spark.createDataFrame(
        [("a", "desk", "FAILED", t(9), None), ("b", "desk", "PENDING", t(9), None), ("c", "desk", "PENDING", t(9, 59), None), ("d", "desk", "FAILED", t(9), t(9, 55)),
         ("e", "desk", "FAILED", t(9), None), ("f", "news", "FAILED", t(9), None), ("g", "desk", "FAILED", t(9), None)],
        "event_id string, destination string, status string, created_at timestamp, claimed_at timestamp",
    )
    due = replay.due_deliveries(deliveries, at("2024-01-01 10:00:00"), "desk")
    assert {r.event_id for r in due.collect()} == {"a", "b", "e", "g"}
    events = spark.createDataFrame(
        [("a", 1, 10.0, "low", t(9, 50)), ("a", 2, 90.0, "high", t(9, 55)), ("b", 3, 1.0, "old", t(8)), ("e", 4, None, "undated", None), ("z", 5, 1.0, "other", t(9))],
        "event_id string, id long, importance double, headline string, published_at timestamp",
    )
    out = replay.replay_outcomes(due, events, at("2024-01-01 10:00:00"), 30)
    assert {r.event_id: (r.headline, r.result, r.reason) for r in out.collect()} == {
        "a": ("high", "READY", None), "b": ("old", "SKIPPED", "stale"), "e": ("undated", "SKIPPED", "unknown"), "g": (None, "UNRESOLVABLE", "no stored event"),
    }
    assert tuple(replay.replay_report(out).first()) == (4, 1, 2, 1, 1)
    assert tuple(replay.replay_report(out.where("false")).first()) == (0, 0, 0, 0, 0)


def test_alert_actions(spark):
    alerts = spark.createDataFrame([("a", ["news", "spx"], "new", True), ("b", ["news"], "x", False)], "event_id string, channels array<string>, content string, supersedes boolean")
    sent = spark.createDataFrame([("a", "news", "1", "old"), ("b", "news", "2", "y")], "event_id string, channel string, message_id string, content string")
    got = {(r.event_id, r.channel): r.action for r in replay.alert_actions(alerts, sent).collect()}
    assert got == {("a", "news"): "EDIT", ("a", "spx"): "POST", ("b", "news"): "NONE"}


def test_relayed_messages(spark):
    forward = "struct<channel_id:string,message_id:string,content:string,embed_author:string,embed_footer:string>"
    schema = f"id long, carrier string, content string, embed_author string, embed_footer string, embed_text string, crosspost struct<channel_id:string,message_id:string>, forward {forward}"
    link = "https://discord.com/channels/12345/67890/13579"
    rows = [
        (1, "bot", "x", None, None, None, ("10", "11"), None),
        (2, "bot", "note", None, None, None, None, ("10", "11", "said", None, None)),
        (3, "bot", "", None, None, None, None, ("10", "11", "said", "walter", "#wire • Server")),
        (4, "bot", f"look {link}", "walter", "#wire • Server", None, None, None),
        (5, "walter", "plain words", "@Walter", None, None, None, None),
        (6, "bot", "**Walter Bloomberg** in #breaking: CPI RISES", None, None, None, None, None),
        (7, "bot", "**BREAKING**: CPI RISES", None, None, None, None, None),
        (8, "bot", link, None, None, None, None, None),
        (9, "bot", None, None, None, "@DeItaone: HEADLINE", None, None),
        (10, None, None, None, None, None, None, None),
    ]
    got = {r.id: r for r in relay.recover_origin(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i].method for i in range(1, 11)] == [
        "crosspost", "forward_snapshot", "forward_snapshot", "embed_author", "direct", "text_prefix", "direct", "message_link", "text_prefix", "direct",
    ]
    assert [got[i].origin_author for i in range(1, 10)] == ["bot", None, "walter", "walter", "walter", "Walter Bloomberg", "bot", None, "@DeItaone"]
    assert (got[2].body, got[2].author_preserved, got[2].origin_channel) == ("said\n\nnote", False, "10")
    assert (got[4].origin_channel, got[4].origin_server, got[4].origin_message_id) == ("67890", "Server", "13579")
    assert (got[6].origin_channel, got[6].body, got[9].body, got[10].body) == ("breaking", "CPI RISES", "HEADLINE", "")


def test_relay_body(spark):
    text = "Macro Alert (@DeItaone):\n\nUS CPI RISES\n\nmore of it\n2024-01-01 08:30\nhttps://x.com/DeItaone/status/1"
    got = one(spark, relay.parse_relay_body(F.col("t"), at("2024-01-01 09:00:00")), t=text)
    assert (got.author, got.handle, got.published_at) == ("Macro Alert", "@DeItaone", dt.datetime(2024, 1, 1, 8, 30))
    assert got.text.startswith("US CPI RISES\n\nmore of it") and "x.com" not in got.text
    got = one(spark, relay.parse_relay_body(F.col("t"), at("2024-01-01 09:00:00")), t="Wire (@a_b): HEADLINE\nof @someone\n2024-01-02 08:30")
    assert (got.handle, got.text.split("\n")[0], got.published_at) == ("@a_b", "HEADLINE", None)
    got = one(spark, relay.parse_relay_body(F.col("t"), at("2024-01-01 09:00:00")), t=None)
    assert (got.author, got.handle, got.text, got.published_at) == (None, None, "", None)


def test_resolver(spark):
    posts = spark.createDataFrame([("a",), ("b",), ("c",)], "post_id string")
    stored = spark.createDataFrame([("a", "stored text", None), ("b", "", None)], "post_id string, text string, published_at timestamp")
    relayed = spark.createDataFrame([("a", "other words entirely", None), ("b", "enough words of text", None), ("b", "short", None), ("c", "few", None)], "post_id string, text string, published_at timestamp")
    got = {r.post_id: (r.text, r.resolved_by) for r in relay.resolve(posts, stored, relayed).collect()}
    assert got == {"a": ("stored text", "stored"), "b": ("enough words of text", "relay"), "c": (None, None)}


def test_news_and_filings(spark):
    now = dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc).timestamp()
    items = f'[{{"id":1,"datetime":{int(now) - 60},"headline":"Up &amp; away","source":"The Wire!","summary":"s","related":"A,B"}},{{"id":2,"datetime":{int(now) - 7200},"headline":"old"}},{{"id":3,"datetime":0,"headline":"undated"}},{{"id":4,"headline":""}}]'
    df = spark.createDataFrame([("finnhub:crypto", items), ("finnhub:general", None), ("finnhub", "no json")], "source_id string, payload string")
    got = {r.source_post_id: r for r in feeds.parse_news(df, at("2024-01-01 12:00:00")).collect()}
    assert set(got) == {"news:1", "news:3"} and got["news:1"].text == "Up & away — s" and got["news:1"].publisher_org == "thewire"
    assert got["news:1"].tickers == ["A", "B"] and got["news:1"].category == "crypto" and got["news:3"].published_at is None
    f = spark.createDataFrame([("ACME", "8-K", ["1.03", "9.01"]), ("ACME", "SC 13D", []), (None, None, None)], "c string, f string, i array<string>")
    said = [r.x for r in f.select(feeds.describe_filing(F.col("c"), F.col("f"), F.col("i"), F.lit("title"), F.lit("")).alias("x")).collect()]
    assert said == ["ACME, files for bankruptcy", "ACME files SC 13D — title", "title"]


def test_watchlist(spark):
    a, b = spark.createDataFrame([("aapl",), ("MSFT ",)], "ticker string"), spark.createDataFrame([("AAPL",), ("",)], "ticker string")
    known = spark.createDataFrame([("rss:news:aapl",)], "id string")
    rows = feeds.watchlist_feeds([a, b], known, {"news": "https://n/{ticker}", "filings": "https://f/{ticker}"}).collect()
    assert {(r.id, r.url) for r in rows} == {("rss:news:msft", "https://n/MSFT"), ("rss:filings:msft", "https://f/MSFT"), ("rss:filings:aapl", "https://f/AAPL")}


def test_small_texts(spark):
    assert one(spark, X.strip_links(F.col("t")), t="see [this](http://a.b) www.c.d end") == "see this  end"
    assert one(spark, X.strip_boilerplate(F.col("t"), ("sent by a bot",)), t="**11:01 AM - CPI UP  Sent by a BOT") == "CPI UP"
    assert one(spark, X.headlines_in(F.col("t")), t="4:03 PM first one 4:05 PM second\n• third line\nno") == ["4:03 PM first one", "4:05 PM second", "third line"]
    assert one(spark, X.names_contract(F.col("t")), t="bought 472C") and not one(spark, X.names_contract(F.col("t")), t=None)
    assert one(spark, X.is_echo(F.col("a"), F.col("b"), F.col("c")), a="RT @x", b="", c="") and not one(spark, X.is_echo(F.col("a"), F.col("b"), F.col("c")), a="own", b="own words", c="other text")


def test_debounced_warnings(spark):
    minutes = [0, 10, 29, 30, 45, 61, 200, 200, 215]
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), i) for k in "ab" for i, m in enumerate(minutes)]
    df = reports.debounced(spark.createDataFrame(rows, "k string, ts timestamp, i int"), "k", "ts")
    for k in "ab":
        shown = sorted(int((r.ts - dt.datetime(2024, 1, 1)).total_seconds() // 60) for r in df.where(f"k = '{k}' AND warn").collect())
        assert shown == [0, 30, 61, 200]
    assert df.count() == len(rows)


def test_reports(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    events = spark.createDataFrame([("PUBLISHED", None, t(9)), ("FILTERED", "NOISE", t(9)), ("PUBLISHED", None, t(10))], "status string, rejection_reason string, ts timestamp")
    deliveries = spark.createDataFrame([("desk", "SENT", t(9))], "destination string, status string, created_at timestamp")
    health = spark.createDataFrame([("ACTIVE",), ("ACTIVE",)], "state string")
    row = reports.metrics_document(events, deliveries, health, "ts", at("2024-01-01 12:00:00")).first()
    assert (row.events, row.rejections, row.deliveries, row.health) == ('{"FILTERED":1,"PUBLISHED":2}', '{"NOISE":1}', '{"desk/SENT":1}', '{"ACTIVE":2}')
    rate = reports.events_per_minute(events, "ts", at("2024-01-01 11:00:00"), at("2024-01-01 12:00:00"), F.col("status") == "PUBLISHED").first()
    assert tuple(rate) == (2, 0.033)


def test_sql_functions(spark):
    assert register(spark, [Security("ACME", "Acme Corp", ambiguity="safe")]) == ["extract_figures", "extract_tickers"]
    row = spark.sql("SELECT extract_tickers('ACME rises') AS t, extract_figures('up 25 bps') AS f").first()
    assert row.t == ["ACME"] and row.f[0].kind == "BPS" and row.f[0].value == 25
