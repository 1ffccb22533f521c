"""The stages one after another on a small corpus."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    clean = lambda k: " ".join(f"topic{k}term{i} and" for i in range(40)) + "."
    texts = {i: clean(i) for i in range(12)}
    texts |= {20: clean(3), 21: clean(3) + " more", 30: "spam ### " * 50, 31: "short", 32: None, 40: " ".join(f"bench{i}" for i in range(30)), 50: clean(50) + " write to joe.doe@mail.example.com"}
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(30)))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, corpus):
    import corpus_pipeline as c
    from tidewire.llm.common import materialize

    df = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, kept = df.columns, []
    for name, stage in c.STAGES:
        df = materialize(stage(spark, df, corpus), name)
        kept.append({r.doc_id for r in df.select("doc_id").collect()})
        if name == "personal_data":
            text = {r.doc_id: (r.text, r.n_chars) for r in df.collect()}
        if name != "packing":
            assert df.columns == columns
    good = {*range(12), 20, 21, 40, 50}
    assert kept == [good, good - {20, 21}, good - {20, 21, 40}, good - {20, 21, 40}, good - {20, 21, 40}]
    assert "joe.doe" not in text[50][0] and text[50][1] == len(text[50][0])
    assert text[1][0].startswith("topic1term0")
    assert {r.doc_id for r in c.run(spark, corpus).collect()} == kept[-1]


CLASHES = ("n_words", "kept", "base_failed", "hit_spans", "item_ids", "n_entities", "kinds", "root", "a", "b", "t", "h", "ids", "place", "_words", "_id")


@pytest.mark.parametrize("name", ["quality_rules", "near_duplicates", "benchmark_decontamination", "personal_data", "packing"])
def test_each_stage_with_odd_tables(spark, corpus, name):
    """Empty tables, repeated and null ids, null and long texts, nulls in every column, and columns named like the stages' own."""
    import corpus_pipeline as c

    stage = dict(c.STAGES)[name]
    from pyspark.sql import functions as F

    clean = lambda k, n=40: " ".join(f"topic{k}term{i} and" for i in range(n)) + "."
    texts = [clean(1), clean(1), clean(2), clean(3), None, "", clean(4, 9000), clean(5) + " mail a.b@c.org", None]
    ids = [1, 1, 1, None, 5, 6, 7, 8, None]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({x: F.lit(f"own {x}") for x in CLASHES})
    if name != "packing":
        empty = stage(spark, df.limit(0), corpus)
        assert empty.count() == 0 and empty.columns == df.columns
    out = stage(spark, df, corpus)
    rows = out.collect()
    if name == "packing":
        from collections import Counter

        want = Counter()
        for r in rows:
            want[r.doc_id] += r.start == 0
        assert want == Counter(ids) and stage(spark, df.limit(0), corpus).count() == 0
        return
    assert out.columns == df.columns and all(r[x] == f"own {x}" for r in rows for x in CLASHES)
    got = sorted(((r.doc_id, r.text) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or ""))
    every = sorted(((i, t) for i, t in zip(ids, texts)), key=lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or ""))
    if name == "quality_rules":
        assert got == [x for x in every if x[1] and len(x[1].split()) >= 20]
    elif name == "near_duplicates":
        assert got == [x for i, x in enumerate(every) if not (x == (1, clean(1)) and i and every[i - 1] == x)]
    elif name == "benchmark_decontamination":
        assert got == every
    else:
        assert len(got) == len(every) and not any("a.b@c.org" in (t or "") for _, t in got)
        assert [x for x in got if x[0] != 8] == [x for x in every if x[0] != 8]
