from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.functions import times as T
from tidewire.functions.figures import figures_of
from tidewire.functions.simhash import simhash64, text_similarity
from tidewire.functions.urls import canonical_url, post_ids


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'timestamp' if isinstance(v, datetime) else 'string'}" for k, v in values.items()))
    return row.select(column).first()[0]


def text(spark, f, value):
    return one(spark, f(F.col("x")), x=value)


def test_cleaning(spark):
    assert text(spark, X.normalize_whitespace, "  a \n\t b c ") == "a b c"
    assert text(spark, X.strip_urls, "see https://a.com/x?y now") == "see now"
    assert text(spark, X.urls_in, "http://a.com and HTTPS://b.com)") == ["http://a.com", "HTTPS://b.com"]
    assert text(spark, X.strip_handles, "RT @bob: hi @ann there") == "hi there"
    assert text(spark, X.strip_trailing_hashtags, "rates up #a #b #c") == "rates up"
    assert text(spark, X.strip_trailing_hashtags, "rates up #a #b") == "rates up #a #b"
    assert text(spark, X.strip_html, "<p>A &amp; B &#8217;s &#65;</p>") == "A & B ’s A"


def test_tokens(spark):
    assert text(spark, X.tokenize, "Apple's META-ANALYSIS rose 2.40 to 198,000") == ["apple", "meta-analysis", "rose", "2.40", "to", "198,000"]
    assert one(spark, X.significant(X.tokenize(F.col("x"))), x="The rate of a bank") == ["rate", "bank"]
    a = one(spark, X.fingerprint(X.tokenize(F.col("x"))), x="Fed raises rates")
    assert a == one(spark, X.fingerprint(X.tokenize(F.col("x"))), x="rates raises the FED") and len(a) == 32


def test_headlines(spark):
    assert text(spark, X.wire_headline, "BREAKING: fed raises rates.") == "FED RAISES RATES"
    got = one(spark, X.headline_and_body(F.col("x")), x="Fed raises rates today. Markets fell.")
    assert tuple(got) == ("FED RAISES RATES TODAY", "Markets fell.")
    got = one(spark, X.headline_and_body(F.col("x")), x="Iran and the US reach a deal — talks go on in Oman")
    assert tuple(got) == ("IRAN AND THE US REACH A DEAL", "talks go on in Oman")
    assert one(spark, X.truncate_words(F.col("x"), 12), x="alpha beta gamma") == "alpha beta..."
    assert text(spark, X.is_all_caps, "FED CUTS 5") and not text(spark, X.is_all_caps, "Fed")
    assert text(spark, X.headline_equivalent, "AXIOS: U.S., Iran & E.U. agree") == "US IRAN AND EU AGREE"


def test_similarity(spark):
    def sim(a, b):
        t = [X.tokenize(X.headline_equivalent(F.col(c))) for c in "ab"]
        return one(spark, text_similarity(t[0], simhash64(t[0]), t[1], simhash64(t[1])), a=a, b=b)

    assert sim("US AND IRAN REACH DEAL", "U.S. and Iran reach deal") == 1.0
    assert sim("US AND IRAN REACH DEAL", "Apple earnings beat estimates") < 0.4
    assert one(spark, simhash64(X.tokenize(F.col("x"))), x="the of") == 0


@pytest.mark.parametrize("text, want", [
    ("Revenue of $(1,200.5) million, EPS -$0.10", [("CURRENCY", "$(1,200.5) million", -1200.5e6, "USD", "revenue"), ("CURRENCY", "$0.10", 0.1, "USD", "eps")]),
    ("€ 5bn vs £-3k, ¥7 trillion.", [("CURRENCY", "€ 5bn", 5e9, "EUR", None), ("CURRENCY", "£-3k", -3e3, "GBP", None), ("CURRENCY", "¥7 trillion", 7e12, "JPY", None)]),
    ("rate cut by 1,250bps or a Half-Point", [("BPS", "250bps", 250.0, "bps", "rate"), ("BPS", "Half-Point", 50.0, "bps", None)]),
    ("+5.5 pct, -3 percent; 12 percents", [("PERCENT", "+5.5 pct", 5.5, "%", None), ("PERCENT", "-3 percent", -3.0, "%", None)]),
    ("trading at 30x or a30x, 2.3.4x", [("MULTIPLE", "30x", 30.0, "x", None), ("MULTIPLE", "3.4x", 3.4, "x", None)]),
    ("$5.5mx $5mx $1.2.3", [("CURRENCY", "$5", 5.0, "USD", None)]),
    ("cpi one two three four five 4%", [("PERCENT", "4%", 4.0, "%", None)]), ("cpi " + "x" * 70 + " 4%", [("PERCENT", "4%", 4.0, "%", None)]),
    ("", []), (None, []), ("3 basis points " * 500, [("BPS", "3 basis points", 3.0, "bps", None)] * 500),
])
def test_figures_of_odd_texts(text, want):
    assert figures_of(text) == want


def test_figures(spark):
    assert [f[:4] for f in figures_of("revenue of $3.5B, EPS $(0.15), up 25 bps and 7% at 30x, half-point")] == [
        ("BPS", "25 bps", 25.0, "bps"), ("BPS", "half-point", 50.0, "bps"), ("PERCENT", "7%", 7.0, "%"),
        ("CURRENCY", "$3.5B", 3.5e9, "USD"), ("CURRENCY", "$(0.15", -0.15, "USD"), ("MULTIPLE", "30x", 30.0, "x"),
    ]
    assert figures_of("revenue of $5")[0][4] == "revenue" and figures_of(None) == []
    different = lambda a, b: one(spark, X.different_figures(F.col("a"), F.col("b")), a=a, b=b)
    assert different("CPI 0.4 vs 0.2", "CLAIMS 198,000 vs 215,000") and not different("CPI 0.4", "CPI 0.4") and not different("CPI", "1")


def test_urls(spark):
    assert text(spark, canonical_url, "https://www.reuters.com/markets/x?utm_source=t") == text(spark, canonical_url, "http://reuters.com/markets/x/") == "reuters.com/markets/x"
    assert text(spark, canonical_url, "https://a.com?b=2&a=1&ref=x") == "a.com/?a=1&b=2"
    assert text(spark, canonical_url, "Not a URL/") == "not a url"
    assert text(spark, post_ids, "https://x.com/a/status/12 https://twitter.com/b/status/12") == ["x:12"]


def test_times(spark):
    at = datetime(2026, 5, 24, 21, 14)
    assert one(spark, T.alert_time(F.col("x")), x=at) == "5:14 PM · May 24, 2026"
    assert one(spark, T.leg(F.lit(None).cast("timestamp"), F.col("x")), x=at) is None
    assert one(spark, T.leg(F.col("x"), F.col("x") - F.expr("INTERVAL 1 HOUR")), x=at) == 0
    fresh = lambda m: tuple(one(spark, T.freshness(F.col("x") - F.make_dt_interval(mins=F.lit(m)), F.col("x"), 30), x=at))
    assert [fresh(m) for m in (1, 31, -6)] == [(True, None), (False, "stale"), (False, "future")]
    assert not one(spark, T.too_old(F.lit(None).cast("timestamp"), F.col("x"), 15), x=at)


def test_a_text_is_read_once_by_each_step(spark):
    """No step spells out the one before it: the plan of a headline names the cleaned text's first step once."""
    from tidewire.functions import text as X

    rows = spark.createDataFrame([("a  b\t\tc  d &amp; x's's it's — the whole of a body told again and again",)], "text string")
    df = rows.select(X.headline_and_body(X.strip_handles(X.strip_urls(X.decode_entities(F.col("text"))))).alias("p"))
    assert df.first()[0][0] == "A B C D & X'S'S IT'S"
    assert df._jdf.queryExecution().executedPlan().toString().count("&(?:amp|#38);") == 1
    blanks = "   　﻿ \t\n\x0b"
    odd = [f"x{a}{b}y{b}" for a in blanks for b in blanks]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", X.normalize_whitespace(F.col("t"))).collect()
    assert {r[1] for r in got} == {"x y"}


def test_hashes_of_tokens_at_once_are_those_one_by_one():
    from tidewire.functions.simhash import _fnv, _voted

    def plain(token):
        h = 0xCBF29CE484222325
        for c in map(ord, token):
            h = ((h ^ c) * 0x100000001B3) % 2**64
        return h

    tokens = ["a", "", "fed", "ünion", "\U0001f600x", "\ud800", "x" * 5_000, "fed-1", *(f"w{i}" for i in range(3_000))]
    assert _fnv(tokens).tolist() == [plain(t) for t in tokens]
    lists = [tokens[:4], [], ["fed", "fed", "a"]]
    want = [sum(1 << b for b in range(64) if sum(1 if plain(t) >> b & 1 else -1 for t in x) > 0) if x else 0 for x in lists]
    assert _voted(lists).tolist() == want


def test_white_space_is_looked_at_once_for_the_same_clean_text(spark):
    odd = [
        None, "", "  ", "a  b  c\n", "see https://a.b/c d @ann  #x #y #z", "RT @bob:  hi\t@ann #a", "#a #b #c", "x @a_b #a #b #c  ", "&amp;#a  &nbsp;@x", "up #a #b #c. end", "a@b  c", "é  #q",
        " #a #b #c #d", "@x", "t &lt;b&gt;　https://x.y @z #1 #2 #3 ",
    ]
    x = F.col("x")
    step_by_step = X.normalize_whitespace(X.strip_trailing_hashtags(X.strip_handles(X.strip_urls(X.decode_entities(x)))))
    df = spark.createDataFrame(list(enumerate(odd)), "i int, x string").select("i", X.cleaned(x).alias("got"), step_by_step.alias("want"))
    for r in df.collect():
        assert r.got == r.want, odd[r.i]
