"""Merkle manifests, WARC archives and ranked search against plain versions, on tables with nulls, long texts, ties and repeats."""

import gzip
import hashlib
import io
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.llm import merkle, ranked_search, warc
from tidewire.llm.common import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _path string, leaf string"
LONG = "line of words\n" * 40_000


# ---------------------------------------------------------------- 11


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """Root, and each node's siblings level by level with its place among them."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for k, i in enumerate(at):
            run = runs[i // 3]
            paths[k].append((i % 3, run[: i % 3] + run[i % 3 + 1 :]))
            at[k] = i // 3
        nodes = [sha(*r) for r in runs]
    return nodes[0], paths


def plain_manifest(rows):
    """Of (doc_id, source, lang, n_chars, text): (doc_id, leaf, subroot, root, proof, folded root)."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    by = {s: sorted(v, key=lambda x: x[:3]) for s, v in by.items()}
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in by[s]]) for s in order}
    root, above = plain_tree([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for (_, _, leaf, r), path in zip(by[s], trees[s][1]):
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                now = plain_leaf((*r[:4], r[4].replace("\n", "")))
            for place, others in path + up:
                now = sha(*others[:place], now, *others[place:])
            out.append((r[0], leaf, trees[s][0], root, sha(*(o for _, others in path + up for o in others)), now))
    return sorted(out, key=repr)


def manifest_rows(sizes):
    rows, k = [], 0
    for source, n in sizes.items():
        for i in range(n):
            text = [None, "", "a\nb\n", f"text {k}", LONG, "ünï\nçode"][i % 6 if k < 40 else 3]
            rows.append((k, source, "en" if i % 3 else None, None if text is None else len(text), text))
            k += 1
    return rows + [rows[0], rows[5], (None, "s1", None, None, "no key\n"), (None, None, None, None, None)]


@pytest.mark.parametrize("top_nodes, levels", [(merkle.TOP_NODES, merkle.LEVELS), (8, 1), (2, 1), (3, 2)])
def test_manifest_equals_plain_version(spark, top_nodes, levels):
    rows = manifest_rows({None: 1, "s1": 90, "s2": 1, "s3": 3, "s4": 10, "Ü": 28, "z": 4, "": 2})
    docs = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "p", "l") for r in rows], DOCS).repartition(5)
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.regexp_replace("text", "\n", ""))
    seen = merkle.leaf_digest(*(F.col(c) for c in merkle.COLUMNS[:-1]), F.coalesce(cut, F.col("text")))
    manifest, root = merkle.merkle_manifest(docs, merkle.COLUMNS, "source", "doc_id", {"seen": seen}, top_nodes, levels)
    checked = merkle.check_leaves(manifest, "seen", root)
    got = [(r.doc_id, r.leaf.hex(), r.subroot.hex(), root, r.proof_sha256, r.folded_root) for r in checked.collect()]
    want = plain_manifest(rows)
    assert sorted(got, key=repr) == want
    assert {r.verified for r in merkle.check_leaves(manifest, "leaf", root).collect()} == {True}
    assert {(r.folded_root == root) == r.verified for r in checked.collect()} == {True}


def test_manifest_of_many_small_and_of_no_groups(spark):
    rows = [(i, f"g{i:03}", "en", 1, "x") for i in range(50)]
    docs = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "p", "l") for r in rows], DOCS)
    manifest, root = merkle.merkle_manifest(docs, merkle.COLUMNS, "source", "doc_id", top_nodes=4, levels=1)
    got = [(r.doc_id, r.leaf.hex(), r.subroot.hex(), root, r.proof_sha256) for r in merkle.check_leaves(manifest, "leaf", root).collect()]
    assert sorted(got, key=repr) == sorted([w[:5] for w in plain_manifest(rows)], key=repr)
    manifest, root = merkle.merkle_manifest(docs.limit(0), merkle.COLUMNS, "source", "doc_id")
    assert root is None and merkle.check_leaves(manifest, "leaf", root).count() == 0
    alone, root = merkle.merkle_manifest(docs.limit(1), merkle.COLUMNS, "source", "doc_id")
    (row,) = merkle.check_leaves(alone, "leaf", root).collect()
    assert row.leaf.hex() == row.subroot.hex() == root and row.proof_sha256 == sha() and row.verified


def test_altered_rows_do_not_fold_to_the_root(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "a" if i % 2 else "b", 2, "p", "l") for i in range(20)], DOCS)
    altered = merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text")))
    manifest, root = merkle.merkle_manifest(docs, merkle.COLUMNS, "source", "doc_id", {"now": altered})
    assert {r.doc_id for r in merkle.check_leaves(manifest, "now", root).collect() if not r.verified} == {7}


# ---------------------------------------------------------------- 12

PAGE = "<p>" + "one page " * 200
PAGES = "page_id long, url string, html string, record_type string, digest string"


def page_rows():
    html = [None, "", "short", "short", PAGE, PAGE, PAGE + "x", "é" * 499, "é" * 500, "é" * 500, "\r\n\r\nWARC/1.0\r\n" * 80, LONG, LONG, "\0" * 1000]
    url = ["http://a.example/?q=1", None, "http://b.example/\r\nWARC-Type: forged", "http://ü.example/ä", ""]
    return [(i if i != 5 else None, url[i % len(url)], h, "t", "d") for i, h in enumerate(html * 2)] + [(100, None, PAGE, "t", "d")] * 2


def plain_pages(rows):
    largest = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            largest[r[2] or ""].append(r[0])
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        kept = max(largest.get(html or "", [i]), key=lambda x: -1 if x is None else x)
        again = len(data) >= 1000 and kept is not None and (i is None or i < kept)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", kept if again else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def archives(spark):
    warc.register(spark)
    path = f"{shared_dir(spark)}/archives"
    rows = page_rows()
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    warc.page_records(df).write.format("warc").mode("append").option("filebytes", 2000).save(path)
    return path, rows


def test_pages_come_back_from_archives(spark, archives):
    path, rows = archives
    assert sorted((tuple(r) for r in warc.read_pages(spark, path).collect()), key=repr) == plain_pages(rows)


def test_pages_of_no_ids_and_no_rows(spark):
    warc.register(spark)
    for rows in ([], [(None, None, PAGE, None, None)] * 2):
        path = f"{shared_dir(spark)}/archives"
        warc.page_records(spark.createDataFrame(rows, PAGES)).write.format("warc").mode("append").save(path)
        got = warc.read_pages(spark, path).collect()
        assert [tuple(r) for r in got] == [(None, len(PAGE), hashlib.sha1(PAGE.encode()).hexdigest(), "response", None)] * len(rows)


def test_payloads_and_headers_round_trip(spark, archives):
    path, rows = archives
    got = spark.read.format("warc").load(path).where("record_type <> 'warcinfo'").collect()
    assert len(got) == len(rows)
    want = Counter((r[2] or "").encode() for r in rows)
    assert set(bytes(r.payload) for r in got if r.record_type == "response") == set(want)
    for r in got:
        assert r.headers["warc-type"] == r.record_type and (r.payload is None) == (r.record_type == "revisit")
        assert "forged" not in (r.headers.get("warc-type") or "") and (r.refers_to is not None) == (r.record_type == "revisit")


@pytest.mark.parametrize("condition", [
    "record_type = 'revisit'", "record_type <> 'response'", "target_uri LIKE 'http://a%'", "target_uri IS NULL", "record_type IN ('response', 'other')",
    "NOT (target_uri LIKE '%example/ä')", "record_id > 'urn:page:2' AND record_id <= 'urn:page:8'", "payload_bytes > 1000", "target_uri <=> null",
    "target_uri = 'x' OR record_type = 'revisit'", "record_type IN ('revisit', NULL)", "NOT record_type IN ('revisit', NULL)",
])
def test_pushed_predicates_equal_those_of_spark(spark, archives, condition):
    path, _ = archives
    schema = "record_id string, record_type string, target_uri string, payload_bytes long"
    df = spark.read.format("warc").schema(schema).load(path)
    held = spark.createDataFrame(df.collect(), schema)
    assert sorted(map(repr, df.where(condition).collect())) == sorted(map(repr, held.where(condition).collect()))


class Counted(io.BytesIO):
    """A file that counts what is read of it."""

    def __init__(self, data):
        super().__init__(data)
        self.total = 0

    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        self.total += n
        return self.getvalue()[at : at + n]


def test_unwanted_payloads_are_neither_read_nor_inflated(monkeypatch):
    big = hashlib.shake_256(b"x").digest(3 << 20)
    rows = [{"record_id": f"urn:page:{i}", "record_type": "response", "payload": big if i % 2 else b"small"} for i in range(6)]
    data = b"".join(warc.gzip_member(warc.record_bytes(r, "2020-01-01T00:00:00Z"), 1) for r in rows)
    assert gzip.decompress(data).count(b"WARC/1.1") == 6
    file = Counted(data)
    assert [r.value("record_id") for r in warc.records(file)] == [r["record_id"] for r in rows]
    assert file.total < len(data) * 0.8
    inflated = []
    step = warc._Member.more
    monkeypatch.setattr(warc._Member, "more", lambda self: inflated.append(len(d := step(self))) or d)
    list(warc.records(Counted(data)))
    assert sum(inflated) < 6 * warc.STEP * 2
    assert [r.payload() for r in warc.records(Counted(data))] == [r["payload"] for r in rows]


@pytest.mark.parametrize("form", ["plain", "gzip", "named gzip"])
def test_archives_of_other_writers(spark, tmp_path, form):
    warc.register(spark)
    rows = [{"record_id": f"urn:x:{i}", "record_type": "response", "payload": b"p%d" % i * (i * 30_000), "target_uri": f"http://h/{i}"} for i in range(4)]
    parts = [warc.record_bytes(r, "2020-01-01T00:00:00Z") for r in rows]
    name = "a.warc"
    if form == "gzip":
        parts, name = [gzip.compress(p) for p in parts], "a.warc.gz"
    elif form == "named gzip":
        name = "a.warc.gz"
        for i, p in enumerate(parts):
            with gzip.GzipFile("name", "wb", fileobj=(buffer := io.BytesIO())) as out:
                out.write(p)
            parts[i] = buffer.getvalue()
    (tmp_path / name).write_bytes(b"".join(parts))
    for path in (tmp_path, tmp_path / name):
        got = spark.read.format("warc").load(f"file://{path}").where("target_uri > 'http://h/0'").orderBy("record_id").collect()
        assert [bytes(r.payload) for r in got] == [r["payload"] for r in rows[1:]]
        assert [r.payload_bytes for r in got] == [len(r["payload"]) for r in rows[1:]]


def test_altered_payloads_are_refused(spark, tmp_path):
    warc.register(spark)
    record = warc.record_bytes({"record_id": "urn:x:1", "record_type": "response", "payload": b"true words"}, "2020-01-01T00:00:00Z")
    (tmp_path / "a.warc").write_bytes(record.replace(b"true", b"fake"))
    with pytest.raises(Exception, match="not that of its digest"):
        spark.read.format("warc").load(f"file://{tmp_path}").collect()
    assert spark.read.format("warc").option("verify", "false").load(f"file://{tmp_path}").count() == 1


def test_overwriting_replaces_what_was_listed(spark):
    warc.register(spark)
    path = f"{shared_dir(spark)}/archives"
    rows = spark.createDataFrame([("urn:x:1", "response", b"a")], "record_id string, record_type string, payload binary")
    for mode, n in (("append", 1), ("append", 2), ("overwrite", 1)):
        rows.write.format("warc").mode(mode).save(path)
        assert spark.read.format("warc").load(path).where("record_type = 'response'").count() == n


# ---------------------------------------------------------------- 13

SEARCHED = "doc_id long, text string, score long, rank int"


def plain_search(docs, items, k=20):
    def terms(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    total, df = sum(sum(c.values()) for _, c in counted), Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * len(counted)) // total
            weight = {t: math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * df[t] + 1))) for t in c}
            score = sum(weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is not None, i or 0))
        out += [(item, rank + 1, i if known else None, -s) for rank, (s, known, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def search_rows(docs, items, spark, **options):
    d = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], SEARCHED).repartition(3)
    b = spark.createDataFrame([(i, t, 0, 0) for i, t in items], SEARCHED.replace("doc_id", "item_id"))
    return sorted((tuple(r) for r in ranked_search.search(d, b, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def some_texts():
    words = [f"w{i}" for i in range(40)] + ["The", "THE", "naïve", "日本", "x-y", "3.5", "İ", "_"]
    texts = [" ".join(words[(i * i * 7 + j * (i % 11 + 1)) % len(words)] for j in range(i % 23)) for i in range(150)]
    return [*enumerate(texts), (200, None), (201, ""), (202, "?!_"), (203, LONG), (None, texts[30]), (None, texts[31]), (30, texts[30]), (30, texts[30])]


@pytest.mark.parametrize("options", [{}, {"k": 3}, {"block_bytes": 60}])
def test_search_equals_scoring_of_all_pairs(spark, monkeypatch, options):
    docs = some_texts()
    items = [(0, "w1 w2 w3"), (1, "the the naïve 日本"), (2, None), (3, ""), (4, "nowhere to be found"), (None, "w5 w5 w6 x y"), (6, "line of words"), (7, "w9"), (7, "w9"), (8, docs[140][1])]
    monkeypatch.setattr(ranked_search, "ROWS", 16)
    assert search_rows(docs, items, spark, **options) == plain_search(docs, items, options.get("k", 20))


def test_search_of_ties_takes_the_least_ids(spark):
    docs = [(i, "same words here") for i in range(60, 0, -1)] + [(i, "other text") for i in range(100, 130)]
    got = search_rows(docs, [(1, "words")], spark)
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == list(range(1, 21)) == [r[2] for r in sorted(plain_search(docs, [(1, "words")]), key=lambda r: r[1])]


def test_search_of_empty_tables(spark):
    assert search_rows([], [(1, "a")], spark) == [] == search_rows([(1, "a")], [], spark) == search_rows([(1, None)], [(1, "a")], spark)


words = st.sampled_from(["a", "b", "c", "d", "rare", "é", "Z9"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(words, max_size=12), min_size=1, max_size=40), st.lists(words, min_size=1, max_size=6), st.integers(1, 4))
def test_no_document_of_the_best_is_pruned(texts, query, k):
    """Thresholds and essential terms leave every one of the best k, without Spark."""
    import numpy as np
    import pyarrow as pa

    block = ranked_search.Block.of([(0, " ".join(query))])
    kept = [ranked_search.terms_of(" ".join(t)) for t in texts if t]
    if not kept:
        return
    known = [sorted(Counter(block.numbers[t] for t in d if t in block.numbers).items()) for d in kept]
    n, size = np.array([len(d) for d in kept]), len(block.numbers)
    lists = [pa.array([[p[j] for p in d] for d in known], pa.list_(t)) for j, t in enumerate((pa.int32(), pa.int64()))]
    post = ranked_search.Postings.of(n, *lists, len(kept), int(n.sum()), size)
    df, best = np.diff(post.starts), [-np.sort(-post[t][1]) for t in range(size)]
    greatest, kth = (np.array([b[i] if len(b) > i else 0 for b in best]) for i in (0, k - 1))
    p = ranked_search.plan(block, df, greatest, kth, len(kept))
    scores = np.zeros(len(kept), dtype=np.int64)
    for t, q in p.essential[0] + p.others[0]:
        scores[post[t][0]] += post[t][1] * p.weights[t] * q
    ranked = np.sort(scores[scores > 0])[::-1]
    if len(ranked) >= k:
        assert ranked[k - 1] >= p.thresholds[0]
    reached = {int(r) for t, _ in p.essential[0] for r in post[t][0]}
    least = max(p.thresholds[0], 1)
    assert {int(i) for i in np.flatnonzero(scores >= least)} <= reached
