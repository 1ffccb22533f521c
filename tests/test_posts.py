"""The whole way of posts, clusters and duplicates, against independent versions written post by post."""

from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import classify, cluster, dedupe, desk, links
from tidewire.operators.extract import Security
from tidewire.plans.posts import Lexicon, normalize, process
from tidewire.sources import shared

T0 = datetime(2026, 5, 28, 12, 0)


def test_fixed_tables():
    assert classify.PRECEDENCE == ("EARNINGS", "FED", "ECONOMIC", "GEOPOLITICAL", "COMMODITY", "CRYPTO", "OPTIONS", "EQUITY", "MARKET", "MACRO")
    reach = {k: set(v) for k, v in cluster.COMPATIBLE.items()}
    assert len(reach) == 12 and all(k in v for k, v in reach.items())
    assert reach["GEOPOLITICAL"] == {"GEOPOLITICAL", "COMMODITY", "MARKET"} and reach["CRYPTO"] == {"CRYPTO"} and reach["ORDER_FLOW"] == {"ORDER_FLOW", "MARKET", "EQUITY", "OPTIONS"}
    roots = cluster.components()
    assert roots["CRYPTO"] == "CRYPTO" and len({r for c, r in roots.items() if c != "CRYPTO"}) == 1
    assert all(roots[a] == roots[b] for a, others in cluster.COMPATIBLE.items() for b in others)


@pytest.mark.parametrize("first,second", [("MARKET", "MACRO"), ("CRYPTO", "EQUITY"), ("EARNINGS", "FED"), ("FED", "ECONOMIC")])
def test_near_ties_go_to_the_earlier(spark, first, second):
    cats = [classify.Category(second, ["alpha", "beta", "gamma"]), classify.Category(first, ["alpha", "beta", "gamma"])]
    df = spark.createDataFrame([("alpha beta gamma",)], "x string")
    v = df.select(classify.classify_category(F.col("x"), F.split("x", " "), cats, F.lit(True)).alias("v")).first().v
    assert v.category == first and v.secondary == [second]


POSTS = "id string, headline string, category string, entities array<string>, kept array<string>, importance double, source_id string, ts timestamp"


def random_posts(n, seed, n_words=14, names=("IRAN", "US", "FED", "ACME", "OIL"), step=6, pause=97, kinds=tuple(sorted(cluster.COMPATIBLE))):
    r = np.random.default_rng(seed)
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n_words)]
    out, minute = [], 0
    for i in range(n):
        minute += int(r.integers(0, step)) if i % pause else 900
        text = " ".join(words[k] for k in r.integers(0, len(words), int(r.integers(1, 7)))) + (f" {int(r.integers(1, 4))}" if r.random() < 0.3 else "")
        if i > 3 and r.random() < 0.2:
            text = out[-int(r.integers(1, 4))][1]
        entities = [names[k] for k in r.integers(0, len(names), int(r.integers(0, 3)))]
        kept = [e for e in entities if e not in ("OIL", "n3")]
        out.append((str(i), text.upper(), kinds[int(r.integers(0, len(kinds)))], entities, kept, float(r.integers(20, 100)), f"s{int(r.integers(0, 4))}", T0 + timedelta(minutes=minute)))
    return out


def clusters_post_by_post(rows, made):
    """Every post compared with every open cluster, in one list, without blocks or an index."""
    clusters, want = [], {}
    for key, _, category, entities, kept, importance, source, ts in sorted(rows, key=lambda x: (x[-1], x[0])):
        p = {"words": frozenset(made[key].words), "simhash": made[key].simhash, "figures": set(made[key].figures), "entities": {e.upper() for e in entities}, "kept": {e.upper() for e in kept}, "ms": made[key].ms}
        best = None
        for c in clusters:
            if p["ms"] - c["ms"] > 240 * 60_000 or c["category"] not in cluster.COMPATIBLE[category] or (p["figures"] and c["figures"] and not p["figures"] & c["figures"]):
                continue
            shared_, s = len(p["entities"] & c["kept"]), cluster.similar(p, c)
            if s >= (0.55, 0.3, 0.12)[min(shared_, 2)] and (best is None or (shared_, s, c["ms"], c["number"]) > best[:4]):
                best = (shared_, s, c["ms"], c["number"], c)
        if best is None:
            clusters.append(p | {"id": key, "number": len(clusters), "category": category, "first": p["ms"], "importance": importance, "sources": {source}})
            want[key] = (key, True, False, 0, 1, 100.0, importance)
            continue
        shared_, s, _, _, c = best
        novelty = 100 - min(70, 18 * len(c["sources"])) - min(20, (p["ms"] - c["first"]) / 60_000 * 0.25) + (1 - s) * 30
        takes = importance >= c["importance"] + 5 or s < 0.5 and importance >= c["importance"]
        if takes:
            c |= {k: p[k] for k in ("words", "simhash", "figures")}
        c |= {"importance": max(c["importance"], importance), "ms": p["ms"], "kept": c["kept"] | p["kept"], "sources": c["sources"] | {source}}
        want[key] = (c["id"], False, takes, shared_, len(c["sources"]), round(min(100, max(0, novelty)), 6), c["importance"])
    return want


def told(rows):
    return {r.id: (r.event_id, r.is_new, r.supersedes, r.shared, r.source_count, round(r.novelty, 6), r.importance) for r in rows}


#: Few words and names, so that all hangs together; many of both, so that blocks are small; slow ones, whose clusters outlive the window.
STREAMS = {
    "dense": lambda: random_posts(300, 3),
    "sparse": lambda: random_posts(400, 5, 300, [f"n{i}" for i in range(250)], 4),
    "lasting": lambda: random_posts(300, 8, 60, [f"n{i}" for i in range(10)], 150, 40, ("CRYPTO", "EQUITY", "FED")),
}


@pytest.mark.parametrize("kind", sorted(STREAMS))
def test_clusters_against_comparison_with_all(spark, monkeypatch, kind):
    monkeypatch.setattr(cluster, "SLICE", 7)
    rows = STREAMS[kind]()
    df = spark.createDataFrame(rows, POSTS)
    prepared = cluster.prepare(df)
    want = clusters_post_by_post(rows, {r.id: r for r in prepared.collect()})
    assert told(cluster.cluster_posts(df.repartition(3)).collect()) == want
    blocks = {r.id: r.block for r in cluster.fold_apart(prepared).collect()}
    largest = max(Counter(blocks.values()).values())
    assert len(blocks) == len(rows) and all(blocks[k] == blocks[v[0]] for k, v in want.items())
    lasting = sum(ts - rows[int(want[k][0])][-1] > timedelta(minutes=240) for k, *_, ts in rows)
    assert {"dense": len(set(blocks.values())) > 3, "sparse": largest < 60 and len(rows) - len({v[0] for v in want.values()}) > 20, "lasting": lasting > 2 and largest < 200}[kind], (largest, lasting, len(set(blocks.values())))


def test_blocks_of_clusters_that_outlive_the_window(spark):
    """A post that has nothing in common with the cluster's last posts, but with its first: by name, and by headline; and a duplicate that keeps one open."""
    def at(m):
        return T0 + timedelta(minutes=m)

    rows = [
        ("1", "ACME OPENS PLANT IN OHIO", "EQUITY", ["ACME"], ["ACME"], 90.0, "a", at(0)), ("2", "ACME OPENS PLANT IN OHIO TODAY", "EQUITY", [], [], 20.0, "b", at(200)),
        ("3", "FACTORY NEWS", "EQUITY", ["ACME"], [], 95.0, "c", at(420)), ("4", "GOLD FALLS SHARPLY AGAIN", "COMMODITY", ["X", "Y"], ["X", "Y"], 90.0, "a", at(0)),
        ("5", "ANOTHER MATTER OF X", "COMMODITY", ["X", "Y"], ["X", "Y"], 10.0, "a", at(230)), ("6", "GOLD FALLS SHARPLY AGAIN", "COMMODITY", [], [], 10.0, "a", at(460)),
    ]
    df = spark.createDataFrame(rows, POSTS)
    got = told(cluster.cluster_posts(df).collect())
    assert got == clusters_post_by_post(rows, {r.id: r for r in cluster.prepare(df).collect()})
    assert got["2"][0] == "1" and got["6"][0] == got["5"][0] == "4"
    extra = [("1", "SOME NEWS", "EQUITY", ["A"], ["A"], 50.0, "a", at(0), None), ("2", "OTHER", "CRYPTO", [], [], 0.0, "b", at(200), "1"), ("3", "SOME NEWS", "EQUITY", ["A"], ["A"], 50.0, "a", at(400), None)]
    got = {r.id: r for r in cluster.cluster_posts(spark.createDataFrame(extra, POSTS + ", repeats string")).collect()}
    assert {r.event_id for r in got.values()} == {"1"} and got["2"].source_count == 2


def test_no_post_is_compared_again_while_its_cluster_is_open_no_longer(spark, monkeypatch):
    calls = []

    def noted(rows, floor):
        calls.append({(r.key, r.ms, r.until, r.simhash) for r in rows.where("NOT own").select("key", "ms", "until", "simhash").collect()})
        return links.similar_links(rows, floor)

    monkeypatch.setattr(cluster, "similar_links", noted)
    cluster.cluster_posts(spark.createDataFrame(STREAMS["lasting"](), POSTS)).count()
    _, *turns = calls
    assert len(turns) > 1 and sum(len(x) for x in turns) == len(set().union(*turns)) > 0


def test_clusters_with_one_common_word_are_not_looked_at():
    class Noted(dict):
        looked = 0

        def __getitem__(self, key):
            Noted.looked += 1
            return super().__getitem__(key)

    def post(i, words):
        return {"id": str(i), "category": "FED", "words": frozenset(words), "simhash": 0, "figures": frozenset(), "entities": frozenset(), "kept": frozenset(), "importance": 1.0, "source_id": "a", "ms": i}

    open_ = cluster.OpenClusters()
    rows = [open_.take(post(i, ["common", *(f"w{i}-{k}" for k in range(12))])) for i in range(100)]
    assert all(r["is_new"] for r in rows)
    open_.clusters = Noted(open_.clusters)
    assert open_.take(post(100, ["common", *(f"w7-{k}" for k in range(12))]))["event_id"] == "7" and Noted.looked < 10


def test_clusters_of_odd_tables(spark):
    rows = [("1", None, None, None, None, None, None, None), ("2", "", "NONE", [], [], None, "a", T0), ("2", "", "NONE", [], [], None, "a", T0), ("3", "word " * 5000, "FED", ["e"] * 50, ["e"], 1.0, "a", T0)]
    got = cluster.cluster_posts(spark.createDataFrame(rows, POSTS)).collect()
    assert Counter(r.id for r in got) == {"1": 1, "2": 2, "3": 1} and sorted(r.event_id for r in got) == ["1", "2", "2", "3"]
    assert cluster.cluster_posts(spark.createDataFrame(rows, POSTS).limit(0)).count() == 0


@pytest.mark.parametrize("one_task", [links.ONE_TASK, 0])
def test_connected_against_search(spark, one_task):
    r = np.random.default_rng(2)
    pairs = [(f"n{a:03}", f"n{b:03}") for a, b in r.integers(0, 150, (90, 2))] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)] + [("hub", f"h{i}") for i in range(30)]
    mates = {}
    for a, b in pairs:
        if a != b:
            mates.setdefault(a, set()).add(b)
            mates.setdefault(b, set()).add(a)
    want = {}
    for node in mates:
        seen, todo = {node}, [node]
        while todo:
            for m in mates[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        want[node] = min(seen)
    got = links.connected(spark.createDataFrame(pairs, "u string, v string"), one_task).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert links.connected(spark.createDataFrame([], "u string, v string"), one_task).count() == 0


def test_duplicates_across_tasks_and_of_late_posts(spark):
    """However posts are ranged into tasks, each is compared with the newest before it; candidates may be dated later than the post."""
    texts = ["OIL RISES AS OPEC CUTS OUTPUT", "FED HOLDS RATES STEADY AGAIN", "ACME BUYS BETA IN CASH DEAL", "STORM CLOSES GULF PORTS TODAY"]
    rows = [(i, f"{texts[i % 4]} {'X' * (i // 40)}", None, T0 + timedelta(minutes=i), T0 + timedelta(minutes=i + (30 if i % 7 == 0 else 0))) for i in range(120)]
    df = spark.createDataFrame([(i, h, h, u, ts, at) for i, h, u, at, ts in rows], "id int, headline string, text string, url string, ts timestamp, arrived timestamp")
    want = None
    for n in ("1", "3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted((tuple(r) for r in dedupe.find_duplicates(df, newest=7).collect()))
        want = want or got
        assert got == want and len(got) == 120 and sum(r[1] is not None for r in got) > 100
        assert all(r[1] is None or 0 < r[0] - r[1] <= 7 for r in got)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert any(m is not None and rows[m][4] > rows[i][3] for i, m, *_ in got)
    unread = df.withColumn("readable", F.col("id") % 2 == 0)
    assert all(r.matched_id is None or r.matched_id % 2 == 0 for r in dedupe.find_duplicates(unread, newest=7).collect())
    assert dedupe.find_duplicates(df.limit(0)).count() == 0
    assert dedupe._contexts([(0, 5), (1, 0), (2, 9), (3, 4)], 7) == [(0, 1, 0), (0, 2, 0), (2, 3, 2)]


def test_near_hashes_against_all_pairs(spark):
    r = np.random.default_rng(4)
    base = r.integers(-(2**63), 2**63 - 1, 60, dtype=np.int64)
    hashes = [int(h) for h in base] + [int(h) ^ int(sum(1 << int(b) for b in r.choice(63, k, replace=False))) for h, k in zip(base, [1, 2, 3, 4, 5] * 12)] + [int(base[0])] * 2 + [0, 0]
    df = spark.createDataFrame(list(enumerate(hashes)), "id int, h long")
    got = sorted(tuple(x) for x in dedupe.near_hashes(df, "id", "h").collect())
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, []).append(i)
    ones = sorted((ids[0], h, len(ids)) for h, ids in first.items() if h)
    apart = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert got == sorted((a, b, apart(g, h), n, m) for a, g, n in ones for b, h, m in ones if a < b and apart(g, h) <= 3) and len(got) >= 36


LEXICON = Lexicon(
    categories=(
        classify.Category("ECONOMIC", ["cpi", "inflation"], ["vs expected"], subcategories={"CPI_RELEASE": ["cpi"]}),
        classify.Category("GEOPOLITICAL", ["strikes", "ceasefire", "talks"], ["nuclear site"]),
        classify.Category("EQUITY", ["shares", "bankruptcy", "acquires", "deal"], ["chapter 11"]),
    ),
    noise={"promotional": ("subscribe", "click here")}, verbs=("says", "declares"), factual=("according to",), commentary=("in my view",),
    high=("emergency", "bankruptcy"), relevance={"ECONOMIC": 90.0, "GEOPOLITICAL": 85.0, "EQUITY": 75.0, "EARNINGS": 80.0},
    securities=(Security("ACME", "Acme Corp", ("Acme",), "safe", ("SPX",), 90),), countries={"IR": ("Iran",), "IL": ("Israel",), "US": ("US",)},
)


def test_the_whole_way_of_posts(spark):
    source = "source_id string, enabled boolean, source_type string, quality_score double, noise_score double, official boolean, filter_profile string, category string"
    sources = spark.createDataFrame(
        [("a", True, "rss", 95.0, 5.0, False, "standard", None), ("b", True, "rss", 90.0, 5.0, False, "standard", None), ("off", False, "rss", 90.0, 5.0, False, "standard", None),
         ("strict", True, "x", 90.0, 5.0, False, "strict", None), ("me", True, "manual", 80.0, 0.0, False, "standard", None)], source,
    )
    rows = [
        (1, "a", "US CPI inflation rises 0.4% vs expected 0.2%", 0, 0), (2, "b", "REUTERS: US CPI inflation rises 0.4% vs expected 0.2%", 3, 3), (3, "off", "US CPI inflation falls", 4, 4),
        (4, "a", "  ", 5, 5), (5, "a", "Manchester beat Arsenal", 6, 6), (6, "a", "Israel strikes Iran nuclear site, says army", 8, 8), (7, "b", "Iran says ceasefire talks follow strikes on nuclear site by Israel", 120, 120),
        (8, "a", "Shares deal: click here, subscribe to chapter 11 news", 25, 25), (9, "strict", "in my view US inflation CPI is a joke, would you agree?", 130, 130),
        (10, "a", "Small franchisee declares bankruptcy under chapter 11", 230, 230), (11, "a", "Acme declares bankruptcy under chapter 11", 330, 330), (12, "b", "Iran strikes and ceasefire talks at nuclear site vs expected", 440, 300),
        (13, "a", "Acme Q3 EPS $2.40 vs $2.35 est, shares rise", 450, 450), (14, "me", "US CPI inflation rises 0.4% vs expected 0.2%", 5, None),
    ]
    minute = lambda m: None if m is None else T0 + timedelta(minutes=m)
    posts = spark.createDataFrame([(i, s, t, None, minute(m), minute(p)) for i, s, t, m, p in rows], "id int, source_id string, text string, url string, ts timestamp, published_at timestamp")
    posts = posts.withColumns({"form": F.when(F.col("id") == 5, "10-Q").cast("string")})
    got = {r.id: r for r in process(posts, sources, LEXICON).collect()}
    assert len(got) == len(rows)
    assert {i: (r.status, r.rejection_reason) for i, r in got.items()} == {
        1: ("PUBLISHED", None), 2: ("DUPLICATE", "DUPLICATE_TEXT"), 3: ("FILTERED", "SOURCE_DISABLED"), 4: ("FILTERED", "EMPTY_TEXT"), 5: ("FILTERED", "NO_CATEGORY"),
        6: ("PUBLISHED", None), 7: ("PUBLISHED", None), 8: ("FILTERED", "NOISE_PROMOTIONAL"), 9: ("FILTERED", "NOISE_COMMENTARY"), 10: ("FILTERED", "NO_IDENTIFIED_SUBJECT"),
        11: ("PUBLISHED", None), 12: ("FILTERED", "NOISE_OLD_NEWS"), 13: ("PUBLISHED", None), 14: ("PUBLISHED", None),
    }
    # The duplicate corroborates the event of what it repeats; so does a curated one, which is published.
    assert got[2].matched_id == 1 and got[2].event_id == got[1].event_id == "1" and got[2].source_count == 2
    assert got[14].event_id == "1" and got[14].source_count == 3 and got[14].score >= 70
    assert got[7].event_id == got[6].event_id == "6" and got[7].novelty < got[6].novelty == 100 and got[7].source_count == 2
    assert got[11].tickers == ["ACME"] and got[11].relevance == "broad" and got[11].channels[0] == "news"
    assert (got[13].category, got[13].headline) == ("EARNINGS", "ACME Q3 EPS ABOVE EXPECTATIONS")
    assert got[12].event_id is None and got[12].score > 50
    assert process(posts.limit(0), sources, LEXICON).count() == 0


def test_filings_that_matter_little(spark):
    sources = spark.createDataFrame([("sec", True, "edgar", 99.0, 0.0, True, "standard", None)], "source_id string, enabled boolean, source_type string, quality_score double, noise_score double, official boolean, filter_profile string, category string")
    rows = [(1, "sec", "Acme files 10-Q, shares and deal", "10-Q", [], "7"), (2, "sec", "Gamma files 8-K, bankruptcy under chapter 11", "8-K", ["1.03"], "8")]
    posts = spark.createDataFrame([(i, s, t, None, T0, None, f, it, c) for i, s, t, f, it, c in rows], "id int, source_id string, text string, url string, ts timestamp, published_at timestamp, form string, items array<string>, cik string")
    got = {r.id: r.rejection_reason for r in process(posts, sources, LEXICON).collect()}
    assert got == {1: "FILING_IMMATERIAL", 2: None}


def test_as_of_join_against_a_scan(spark):
    r = np.random.default_rng(6)
    left = [(i, int(k), T0 + timedelta(seconds=int(s))) for i, (k, s) in enumerate(zip(r.integers(0, 5, 200), r.integers(0, 20_000, 200)))]
    right = [(int(k), T0 + timedelta(seconds=int(s)), int(v)) for k, s, v in zip(r.integers(0, 5, 80), r.integers(0, 20_000, 80), r.permutation(80))]
    a, b = spark.createDataFrame(left, "i int, k int, ts timestamp"), spark.createDataFrame(right, "k int, ts timestamp, v int")
    got = {x.i: None if x.m is None else x.m.ts for x in desk.as_of(a, b, ["k"], "ts", 900_000, "m").collect()}
    for i, k, ts in left:
        near = [t for kk, t, _ in right if kk == k and ts - timedelta(seconds=900) <= t <= ts]
        assert got[i] == (max(near) if near else None)


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Away:
        master = "spark://host:7077"

    class Session:
        sparkContext = Away()

        class conf:
            @staticmethod
            def get(key, other=None):
                return None

    with pytest.raises(ValueError):
        shared.work_dir(Session())


def test_names_speak_for_categories(spark):
    schema = "i int, tickers array<struct<ticker:string,confidence:double>>, countries array<string>, organizations array<string>, people array<string>, commodities array<string>"
    rows = [
        (0, [("A", 0.8)], ["US", "IR"], ["Fed", "BLS"], ["Trump", "POWELL"], ["OIL"]), (1, [("A", 0.7)], ["US"], ["ACME"], ["ANNA"], []), (2, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    boosts = classify.entity_boosts(*(F.col(c) for c in df.columns[1:]))
    got = {r.i: r.asDict() for r in df.select("i", *(c.alias(n) for n, c in boosts.items())).collect()}
    assert got[0] == {"i": 0, "EQUITY": 2.0, "EARNINGS": 2.0, "GEOPOLITICAL": 3.0, "COMMODITY": 2.0, "FED": 4.5, "ECONOMIC": 2.0}
    assert set(got[1].values()) == {1, 0.0} and set(got[2].values()) == {2, 0.0}
    c = classify.Category("EARNINGS", ["eps"])
    said = spark.createDataFrame([("eps up", 0), ("shares up", 1)], "x string, i int")
    score = classify.category_score(F.col("x"), F.split("x", " "), c, F.lit(2.0))
    assert [r.s for r in said.orderBy("i").select(score.alias("s")).collect()] == [3.0, 0.0]


def test_a_quote_that_copies_is_an_echo(spark):
    rows = [
        (1, "Iran and US reach nuclear deal after talks", "Iran and US reach nuclear deal after talks"), (2, "Sources tell us the deal excludes missiles", "Iran and US reach nuclear deal after talks"),
        (3, "RT @wire: https://x.example/1", None), (4, "Plain post", None), (5, "", "Iran"), (6, None, None),
    ]
    got = {r.id: r.is_echo for r in normalize(spark.createDataFrame(rows, "id int, text string, quoted_text string")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False}


def brute_pairs(rows, floor):
    sets = {}
    for k, words in rows:
        if words:
            sets.setdefault(frozenset(words), []).append(k)
    found, listed = set(), sorted((min(ks), s, len(ks)) for s, ks in sets.items() if s)
    for i, (k, x, n) in enumerate(listed):
        for o, y, m in listed[i + 1 :]:
            if (s := len(x & y) / len(x | y)) >= floor:
                found.add((k, o, s, n, m))
    return found


@pytest.mark.parametrize("floor", [0.5, 0.8, 1.0])
@pytest.mark.parametrize("block", [60, 10_000])
def test_alike_sets_by_blocks_without_a_shuffle_of_pairs(spark, monkeypatch, floor, block):
    r = np.random.default_rng(3)
    rows = [(i, [f"w{int(w)}" for w in r.zipf(1.4, int(r.integers(0, 14))) % 40]) for i in range(220)] + [(300, None), (301, []), (302, ["w1"]), (303, ["w1"])]
    monkeypatch.setattr(dedupe, "BLOCK_WORDS", block)
    df = dedupe.similar_pairs(spark.createDataFrame(rows, "id long, w array<string>"), "id", F.col("w"), floor)
    got = [tuple(x) for x in df.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, floor)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_alike_sets_of_more_words_than_bits(monkeypatch):
    import pyarrow as pa

    r = np.random.default_rng(5)
    sets = [sorted({int(w) for w in r.zipf(1.2, 30) % 5_000}) for _ in range(200)]
    monkeypatch.setattr(dedupe, "BIT_WORDS", 64)
    table = lambda some: pa.table({"key": pa.array(range(len(some))), "rows": pa.array([1] * len(some)), "set": pa.array(some, pa.list_(pa.int64())), "n": pa.array([len(s) for s in some])})
    index = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    got = {(i, int(j)): float(s) for i, near, sims in dedupe._alike(table(sets[:90]), table(sets[90:]), 0.2) for j, s in zip(near, sims)}
    assert got == {(i, j): s for i, x in enumerate(sets[:90]) for j, y in enumerate(sets[90:]) if (s := index(x, y)) >= 0.2}
    got = {(i, int(j)) for i, near, _ in dedupe._alike(table(sets), None, 0.2) for j in near}
    assert got == {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and index(x, y) >= 0.2}


def test_no_alike_sets_of_an_empty_table(spark):
    df = dedupe.similar_pairs(spark.createDataFrame([], "id long, w array<string>"), "id", F.col("w"), 0.5)
    assert df.columns == ["key", "other", "similarity", "n_key", "n_other"] and df.count() == 0


def bytes_written_for(spark, run):
    top = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(top.rglob("*.parquet"))
    run().write.format("noop").mode("overwrite").save()
    return sum(p.stat().st_size for p in set(top.rglob("*.parquet")) - before if p.is_file())


def long_posts(spark, n=40, words=3000):
    r = np.random.default_rng(5)
    text = lambda: " ".join("".join(chr(97 + k) for k in r.integers(0, 26, 9)) for _ in range(words))
    rows = [(i, "a", f"US CPI inflation report {i}. {text()}", None, T0 + timedelta(minutes=i), T0 + timedelta(minutes=i)) for i in range(n)]
    posts = spark.createDataFrame(rows, "id int, source_id string, text string, url string, ts timestamp, published_at timestamp")
    sources = spark.createDataFrame([("a", True, "rss", 90.0, 5.0, False, "standard", None)], "source_id string, enabled boolean, source_type string, quality_score double, noise_score double, official boolean, filter_profile string, category string")
    return posts, sources, sum(len(x[2]) for x in rows)


def test_texts_of_posts_that_are_judged_twice_go_to_no_disk(spark, monkeypatch):
    from tidewire.plans import queries

    posts, _, size = long_posts(spark)
    monkeypatch.setattr(queries, "_posts", lambda s, d: posts)
    # Hashes of different words are kept (8 bytes for each of these, which have 10), no text and no token.
    assert bytes_written_for(spark, lambda: queries.QUERIES["replayed_posts"](spark, "")) < 1.2 * size


def test_a_text_is_written_once_on_its_way(spark):
    posts, sources, size = long_posts(spark)
    # Once as it is cleaned, and hashes of different words, of 8 bytes each.
    assert bytes_written_for(spark, lambda: process(posts, sources, LEXICON)) < 2.2 * size


def test_tokens_are_cut_where_they_are_hashed(spark):
    from tidewire.functions import simhash
    from tidewire.functions import text as X
    from tidewire.plans import queries

    plan = queries.QUERIES["simhash_near_dups"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # Conditions of a candidate: one for each block of bits, not for each three of them.
    assert sum(line.count("shiftrightunsigned") for line in plan.splitlines() if "Join" in line) == 6
    texts = ["The U.S. economy’s 1,000.5 up x-ray-2 's It's", "K’s İstanbul's", "a퟿b ٣ 12. ab", "the a of", "", None, "one two one", "two ONE  one"] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    tokens = X.tokenize(F.coalesce("t", F.lit("")))
    rows = df.select("t", simhash.simhash64(tokens).alias("old"), simhash.text_simhash64(F.col("t")).alias("new"), F.array_distinct(X.significant(tokens)).alias("words"), simhash.text_words(F.col("t")).alias("hashes")).collect()
    assert all(r.old == r.new and len(r.hashes) == len(set(r.hashes)) == len(r.words) for r in rows) and rows[-1].hashes and rows[4].old == 0
    known = {w: h for r in rows if len(r.words) == 1 for w, h in zip(r.words, r.hashes)}
    assert all(known[w] in r.hashes for r in rows for w in r.words if w in known)
    assert {frozenset(r.hashes) for r in rows if r.t == "one two one"} == {frozenset(r.hashes) for r in rows if r.t == "two ONE  one"}


def test_words_of_sets_are_made_once_and_few_pairs_are_looked_at(spark):
    import pyarrow as pa

    r = np.random.default_rng(8)
    seen = spark.sparkContext.accumulator(0)

    def told(words):
        seen.add(1)
        return words

    rows = [(i, [f"w{int(w)}" for w in r.integers(0, 30, 6)]) for i in range(50)] + [(50, [])]
    words = F.udf(told, "array<string>")(F.col("w"))
    got = {tuple(x) for x in dedupe.similar_pairs(spark.createDataFrame(rows, "id long, w array<string>"), "id", words, 0.5).collect()}
    assert got == brute_pairs(rows, 0.5) and seen.value == len(rows)

    sizes = [*r.integers(20, 400, 300), 6_000, 6_100]
    sets = [{int(w) for w in r.integers(0, 40_000, n)} for n in sizes]
    sets += [{*sorted(s)[: int(len(s) * 0.8)]} for s in sets[:20] + sets[-1:]]
    table = pa.table({"key": pa.array(range(len(sets))), "rows": pa.array([1] * len(sets)), "set": pa.array([sorted(s) for s in sets], pa.list_(pa.int64())), "n": pa.array([len(s) for s in sets])})
    block = dedupe._Block(table)
    near = {frozenset((int(i), int(j))) for x, y in dedupe._near_pieces(block, block, 0.5) for i, j in zip(x, y)}
    alike = {frozenset((i, j)) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 2 * len(a & b) >= len(a | b)}
    assert len(alike) == 21 and alike <= near and len(near) < 100
    assert {frozenset((i, int(j))) for i, near, _ in dedupe._alike(table, None, 0.5) for j in near} == alike
