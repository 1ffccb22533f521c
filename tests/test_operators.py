from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.functions.text import tokenize
from tidewire.operators import calendar, classify, cluster, dedupe, health, merge, score
from tidewire.operators.extract import Security, TickerFinder, extract_entities, extract_tickers

T0 = datetime(2026, 5, 28, 12, 0)


def posts(spark, rows):
    """(id, headline, url, minutes)"""
    data = [(i, h, h, u, T0 + timedelta(minutes=m)) for i, h, u, m in rows]
    return spark.createDataFrame(data, "id long, headline string, text string, url string, ts timestamp")


def test_duplicates(spark):
    df = posts(spark, [
        (1, "US AND IRAN REACH DEAL", None, 0), (2, "U.S. AND IRAN HAVE REACHED AGREEMENT", None, 5), (3, "AXIOS: US, IRAN REACH AGREEMENT", None, 9),
        (4, "US AND IRAN TALKS COLLAPSE, NO DEAL REACHED", None, 10), (5, "US AND IRAN REACH DEAL", None, 210),
        (6, "SOMETHING ELSE ENTIRELY HAPPENED", "https://www.a.com/x?utm_source=t", 300), (7, "QUITE ANOTHER WORDING", "http://a.com/x/", 310),
    ])
    got = {r.id: (r.matched_id, r.reason) for r in dedupe.find_duplicates(df).collect()}
    assert got[1] == (None, None) and got[2][0] == 1 and got[3][0] in (1, 2)
    assert got[4] == (None, None) and got[5] == (None, None)
    assert got[7] == (6, "DUPLICATE_URL")


def test_landing_keeps_the_first(spark):
    df = spark.createDataFrame([("s", "a", T0, 1), ("s", "a", T0 + timedelta(1), 2), ("t", "a", T0, 3)], "source_id string, source_post_id string, ingestion_time timestamp, n int")
    assert sorted(r.n for r in dedupe.land(df).collect()) == [1, 3]


def cluster_rows(spark, rows):
    data = [(str(i), "b", h, c, e, float(v), s, T0 + timedelta(minutes=m)) for i, h, c, e, v, s, m in rows]
    return spark.createDataFrame(data, "id string, block string, headline string, category string, entities array<string>, importance double, source_id string, ts timestamp")


def test_clusters(spark):
    got = {r.id: r for r in cluster.cluster_posts(cluster_rows(spark, [
        (1, "ISRAEL STRIKES IRAN NUCLEAR SITE", "GEOPOLITICAL", ["Israel", "Iran"], 80, "a", 0),
        (2, "IRAN SAYS ISRAEL STRIKES HIT NUCLEAR SITE", "GEOPOLITICAL", ["iran", "israel"], 82, "b", 15),
        (3, "CPI RISES 0.4% VS 0.2% EXPECTED", "ECONOMIC", ["US"], 70, "a", 20), (4, "JOBLESS CLAIMS 198,000 VS 215,000 EXPECTED", "ECONOMIC", ["US"], 60, "a", 22),
        (5, "IRAN SAYS ISRAEL STRIKES HIT NUCLEAR SITE", "GEOPOLITICAL", ["Iran", "Israel"], 95, "b", 400),
    ])).collect()}
    assert got["2"].event_id == "1" and got["2"].source_count == 2 and got["2"].importance == 82
    assert {got[i].event_id for i in "345"} == {"3", "4", "5"} and got["1"].novelty == 100


def test_bands_and_scores(spark):
    totals = [95, 90, 89, 75, 74, 60, 59, 40, 39]
    got = [r[0] for r in spark.createDataFrame([(float(t),) for t in totals], "t double").select(score.band(F.col("t"))).collect()]
    assert got == ["CRITICAL", "CRITICAL", "HIGH", "HIGH", "MODERATE", "MODERATE", "LOW", "LOW", "IGNORE"]
    df = spark.range(1)
    parts = {n: F.lit(50.0) for n in score.WEIGHTS}
    assert df.select(score.total_score(parts)).first()[0] == pytest.approx(50)
    assert df.select(score.total_score(parts, F.lit("manual"))).first()[0] == 70
    assert df.select(score.total_score(parts, F.lit("rss"), F.lit("ORDER_FLOW"))).first()[0] == 100
    assert df.select(score.clamp(F.lit(float("nan")))).first()[0] == 0
    assert sum(score.WEIGHTS.values()) == pytest.approx(1)


def test_routes(spark):
    def go(moving, macro, relevance, category, n):
        return spark.range(1).select(score.route(F.lit(moving), F.lit(macro), F.lit(relevance), F.lit(category), F.lit(n))).first()[0]

    assert go(False, True, "broad", "FED", 1) == ["news"]
    assert go(True, True, "none", "FED", 0) == ["news", "spx"]
    assert go(True, False, "single_name", "EQUITY", 1) == ["news", "tradingFloor"]
    assert go(True, False, "none", "MACRO", 0) == ["news", "spx", "tradingFloor"]


def test_categories(spark):
    cats = [classify.Category("ECONOMIC", ["cpi", "inflation"], ["vs expected"], subcategories={"CPI_RELEASE": ["cpi"]}), classify.Category("EQUITY", ["shares"], requires=["buyback", "stake"])]

    def of(text, market=False, curated=False):
        df = spark.createDataFrame([(text,)], "x string")
        return df.select(classify.classify_category(F.col("x"), tokenize(F.col("x")), cats, F.lit(market), F.lit(curated)).alias("v")).first()["v"]

    assert of("Manchester United beat Arsenal 3-1") is None
    v = of("US CPI inflation rises 0.3% vs expected")
    assert (v.category, v.subcategory) == ("ECONOMIC", "CPI_RELEASE")
    assert of("cpi") is None and of("cpi", market=True).confidence == pytest.approx(1 / 24)
    assert of("shares rise") is None and of("shares rise on buyback").category == "EQUITY"
    assert of("nothing", curated=True).category == "MACRO"


def test_noise_and_factuality(spark):
    lexicon = {"opinion": ["i think", "imo", "pathetic"], "promotional": ["subscribe"]}

    def noise(text, quality=50.0):
        df = spark.createDataFrame([(text,)], "x string")
        return df.select(classify.classify_noise(F.col("x"), tokenize(F.col("x")), lexicon, quality=F.lit(quality)).alias("v")).first()["v"].reason

    assert noise("I think rates fall") == "NOISE_OPINION" and noise("I think rates fall", 99.0) is None
    assert noise("la casa de los gatos es grande por favor") == "NOISE_FOREIGN_LANGUAGE"
    assert noise("one 🚀 two ☕ three ⏰") == "NOISE_MEME" and noise("flags 🇺🇸🇺🇸 are none 🚀🚀") is None
    assert noise("to the moon 🚀🚀🚀") == "NOISE_MEME" and noise("Fed cuts rates") is None and noise("subscribers grew") is None

    def fact(text):
        df = spark.createDataFrame([(text,)], "x string")
        v = classify.classify_factuality(F.col("x"), tokenize(F.col("x")), F.col("x").rlike("\\d"), ["says"], ["according to"], ["in my view"])
        return df.select(v.alias("v")).first()["v"].verdict

    assert fact("REUTERS: Fed says rates at 5") == "FACTUAL_NEWS" and fact("why would you buy this?") == "COMMENTARY"


def test_filings(spark):
    def level(form, items=(), title=""):
        df = spark.createDataFrame([(form, list(items), title)], "f string, i array<string>, t string")
        return df.select(classify.filing_materiality(F.col("f"), F.col("i"), F.col("t"))).first()[0]

    assert [level("SC 13D"), level("SC 13D/A"), level("10-K"), level("3"), level("8-K"), level(None)] == ["CRITICAL", "HIGH", "MEDIUM", "IGNORE", "MEDIUM", "IGNORE"]
    assert level("8-K", ["9.01", "1.03"]) == "CRITICAL" and level("8-K", ["5.02"]) == "HIGH" and level("8-K", ["5.02"], "CEO leaves") == "CRITICAL"


def test_tickers_and_entities(spark):
    master = [Security("META", "Meta Platforms, Inc.", ("Facebook",), "safe"), Security("ALL", "Allstate Corp", (), "ambiguous"), Security("NOW", "ServiceNow", (), "blocked")]
    find = lambda t: [x[0] for x in TickerFinder(master).find(t)]
    assert find("META-ANALYSIS shows gains") == [] and find("$META announces") == ["META"] and find("Facebook grows") == ["META"]
    assert find("ALL quiet") == [] and find("ALL shares rise") == ["ALL"] and find("buy NOW shares") == []
    df = spark.createDataFrame([("Meta Platforms and the US with South Korea and Korea",)], "x string")
    assert df.select(extract_tickers(F.col("x"), master).alias("t")).first().t[0].ticker == "META"
    lexicon = {"KR": ["South Korea"], "KP": ["Korea"], "USA": ["US"]}
    assert df.select(extract_entities(F.col("x"), lexicon).alias("e")).first().e == ["KR", "KP", "USA"]


def test_health(spark):
    rows = [("a", 0, False), ("a", 1, False), ("a", 2, False), ("b", 0, True), ("c", 0, True), ("c", 5, False), ("d", -60, True), ("e", -20, True)]
    df = spark.createDataFrame([(s, T0 + timedelta(minutes=m), ok) for s, m, ok in rows], "s string, ts timestamp, ok boolean")
    got = {r.s: r.state for r in health.evaluate(df, "s", "ts", F.col("ok"), F.col("ok").cast("int"), F.lit(T0 + timedelta(minutes=6))).collect()}
    assert got == {"a": "DISCONNECTED", "b": "ACTIVE", "c": "ERROR", "d": "STALE", "e": "DELAYED"}


def test_merges(spark):
    a = spark.createDataFrame([(1, "x", "h1", 1), (2, "y", "", 1)], "id int, name string, hash string, v int")
    b = spark.createDataFrame([(1, "z", "", 2), (3, "w", None, 2)], "id int, name string, hash string, v int")
    got = {r.id: (r.name, r.hash) for r in merge.upsert(a, b, ["id"], "v", ["hash"]).collect()}
    assert got == {1: ("z", "h1"), 2: ("y", None), 3: ("w", None)}
    kept = merge.retain(spark.createDataFrame([(i, T0 - timedelta(days=i)) for i in range(10)], "i int, ts timestamp"), "ts", F.lit(T0), 5, 3)
    assert sorted(r.i for r in kept.collect()) == [0, 1, 2]


def test_reminders(spark):
    events = spark.createDataFrame([("cpi", "CPI", T0 + timedelta(minutes=61)), ("nfp", "NFP", T0 + timedelta(minutes=15)), ("old", "OLD", T0 - timedelta(minutes=1)), ("far", "FAR", T0 + timedelta(minutes=30))], "id string, name string, scheduled_at timestamp")
    fired = spark.createDataFrame([("nfp:15",)], "key string")
    assert [r.headline for r in calendar.due_reminders(events, fired, F.lit(T0)).collect()] == ["CPI IN 1 HOUR"]


def test_near_hashes_are_merged_not_broadcast(spark):
    from tidewire.operators.dedupe import near_hashes

    hashes = [3, 2, 1 << 40, (1 << 40) + 5, 0, None, 3, -1, -2]
    rows = spark.createDataFrame(list(enumerate(hashes)), "id int, h long")
    found = near_hashes(rows, "id", "h")
    one = {h: (min(i for i, x in enumerate(hashes) if x == h), hashes.count(h)) for h in hashes if h}
    want = {(*sorted((a[0], b[0])), bin((x ^ y) & (2**64 - 1)).count("1")) for x, a in one.items() for y, b in one.items() if a[0] < b[0]}
    assert {tuple(r)[:3] for r in found.collect()} == {w for w in want if w[2] <= 3}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
