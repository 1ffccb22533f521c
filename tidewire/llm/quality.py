"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import materialize, put_aside, read_table

#: White space that separates words.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words of a window of the test for repeated passages.
WINDOW = 8
#: Rows, about, on which cost and selectivity of each rule are estimated, and how often each is timed.
SAMPLE_ROWS, TIMINGS = 2_000, 2


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text; an empty array if it has none."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _joined(df: DataFrame, of: str, step: int, out: str) -> DataFrame:
    """Adds hashes of runs twice as long as those of ``of``: of each run and the one ``step`` places on."""
    n = F.size(of) - step
    longer = F.zip_with(F.slice(of, F.lit(1), n), F.slice(of, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))
    return df.withColumn(out, longer)


def with_repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Counts words that lie in a window of 8 words found twice or more in the text.

    Windows are compared by a 64-bit hash: each word is hashed once, and hashes of
    2, 4 and 8 words are made of two of half as many.  Only rows with two equal
    hashes sort them, with their places, to find the words covered.
    """
    own = F.when(F.size(words) >= WINDOW, F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn("__words1", own)
    for step in (1, 2, 4):
        df = _joined(df, f"__words{step}", step, f"__words{2 * step}")
    df = df.withColumn("__windows", F.coalesce("__words8", F.array().cast("array<long>"))).drop("__words1", "__words2", "__words4", "__words8")
    placed = F.when(
        F.size(F.array_distinct("__windows")) < F.size("__windows"),
        F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    df = df.withColumn("__placed", placed).drop("__windows")

    def same(a: Column, b: Column) -> Column:
        return a.eqNullSafe(b)

    def found(x: Column, i: Column) -> Column:
        return same(F.get("__placed", i - 1)["h"], x["h"]) | same(F.get("__placed", i + 1)["h"], x["h"])

    places = F.sort_array(F.transform(F.filter("__placed", found), lambda x: x["i"]))
    df = df.withColumn("__places", places).drop("__placed")
    steps = F.zip_with(
        F.slice("__places", F.lit(2), F.size("__places")),
        "__places",
        lambda after, at: F.least(F.lit(WINDOW), F.coalesce(after - at, F.lit(WINDOW))),
    )
    total = F.aggregate(steps, F.lit(0), lambda a, x: a + x)
    return df.withColumn(out, F.coalesce(total, F.lit(0)).cast("long")).drop("__places")


#: What ``with_counts`` and ``judge_quality`` add.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*COUNTS, "base_failed", "kept")


def with_light_counts(docs: DataFrame) -> DataFrame:
    """Adds all counts but ``n_repeat_words``, which costs more than all others, and the words, as ``__words``."""
    text = _text()
    return docs.withColumn("__words", words_of(text)).withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": n_dup_lines(text),
        }
    )


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; a null text counts as empty."""
    return with_repeat_words(with_light_counts(docs), "__words", "n_repeat_words").drop("__words")


#: Up to so many words, a tenth of them have to be different.
VARIETY_WORDS = 10_000


@dataclass(frozen=True)
class Rule:
    """A named test; ``rejects`` is true for rows to be rejected and never null; ``heavy`` ones need ``n_repeat_words``."""

    name: str
    rejects: Column
    heavy: bool = False


def base_rules() -> list[Rule]:
    """Over the columns of ``with_counts``: too few words, and repeated passages."""
    return [
        Rule("few_words", F.col("n_words") < 20),
        Rule("repeated_passages", 100 * F.col("n_repeat_words") > 30 * F.col("n_words"), heavy=True),
    ]


def method_rules() -> list[Rule]:
    """Over the columns of ``with_counts`` and the text."""
    text, n = _text(), F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(1))
    upper = F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}", ""))
    marks = F.length(text) - F.length(F.translate(text, "!?", ""))
    words = F.array_distinct(words_of(text))
    return [
        Rule("many_symbols", 10 * F.col("n_symbols") > n),
        Rule("same_lines", 10 * F.col("n_dup_lines") > 3 * lines),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("shouting", 2 * upper > F.greatest(F.col("word_chars"), F.lit(1))),
        Rule("exclamations", 5 * marks > n),
        # Beyond VARIETY_WORDS the bound grows with the root of the length, as different words of clean texts do or faster.
        Rule("few_different_words", 10 * F.size(words) < F.least(n, F.sqrt(n * F.lit(float(VARIETY_WORDS))))),
    ]


def _seconds(df: DataFrame) -> float:
    """The least of several runs, each of which computes every row and keeps none; the first also compiles."""
    def run() -> float:
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    run()
    return min(run() for _ in range(TIMINGS))


def order_rules(sample: DataFrame, rules: Sequence[Rule]) -> list[tuple[Rule, float, float]]:
    """Rules with their rejected share and seconds on a sample of texts, by rejection per second, best first.

    A rule's cost is that of a job which computes it from the text, less that of a
    job which only reads and counts the light measures that all rules share.  The
    order changes what is computed, never what is rejected.
    """
    light = with_light_counts(sample)
    counted = with_repeat_words(light, "__words", "n_repeat_words")
    of = lambda r: (counted if r.heavy else light)
    rows = counted.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(r.rejects).alias(f"r{i}") for i, r in enumerate(rules)))
    counts = rows.first()
    shared = _seconds(light.select("n_words", "word_chars", "n_symbols", "n_dup_lines"))
    found = []
    for i, rule in enumerate(rules):
        took = _seconds(of(rule).select("n_words", "word_chars", "n_symbols", "n_dup_lines", rule.rejects.alias("rejects"))) - shared
        found.append((rule, counts[f"r{i}"] / max(counts["n"], 1), max(took, 1e-3)))
    return sorted(found, key=lambda x: -x[1] / x[2])


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does; later rules aren't computed for a row already rejected."""
    first = None
    for rule in rules:
        first = F.when(rule.rejects, F.lit(rule.name)) if first is None else first.when(rule.rejects, F.lit(rule.name))
    return first if first is not None else F.lit(None).cast("string")


def bounded_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About so many random rows, written once, to a few files: each timing is a small job."""
    total = docs.count()
    return materialize(docs.sample(False, min(1.0, rows / max(total, 1)), 11).repartition(4), "sample")


def all_rules() -> list[Rule]:
    return [*base_rules(), *method_rules()]


def _here() -> Column:
    """Always true, but not known to be: a filter on what stands beside it stays above the measures, which
    would else be spelled out in the filter at each use."""
    return F.monotonically_increasing_id() >= 0


def judge_quality(docs: DataFrame) -> DataFrame:
    """Every row with its counts, ``base_failed`` and ``kept``; needs ``doc_id`` and ``text``.

    Null and empty texts have no words and fail.  Equal texts fare alike and each
    row stays; an empty table gives an empty table.  Other columns pass through; one
    that has the name of a count is replaced.
    """
    counted = with_counts(docs)
    ordered = [r for r, _, _ in order_rules(bounded_sample(docs.select("text")), all_rules())]
    base = F.lit(False)
    for rule in base_rules():
        base = base | rule.rejects
    return counted.withColumns({"base_failed": base, "kept": cascade(ordered).isNull() & _here()})


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that no rule rejects, with their own columns, whatever their names.

    Rules are filters one after another, in the order found; the costly measure is
    computed where the first rule that needs it stands, for the rows that are left.
    """
    ordered = [r for r, _, _ in order_rules(bounded_sample(docs.select("text")), all_rules())]
    rows, own = put_aside(docs, ADDED)
    rows, pending, counted = with_light_counts(rows), [], False

    def passed(rows: DataFrame, rules: list[Rule]) -> DataFrame:
        return rows.withColumn("__good", cascade(rules).isNull() & _here()).where("__good").drop("__good") if rules else rows

    for rule in ordered:
        if rule.heavy and not counted:
            rows = with_repeat_words(passed(rows, pending), "__words", "n_repeat_words")
            pending, counted = [], True
        pending.append(rule)
    return passed(rows, pending).select(*own)


def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document."""
    rows = judge_quality(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_sql() -> str:
    blank = "[\\x20\\x09-\\x0D]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
i AS (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW}),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, list_slice(words, i, i + {WINDOW - 1})) AS n FROM i),
p AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS j FROM g WHERE n > 1),
r AS (SELECT rid, sum(least({WINDOW}, coalesce(j - i, {WINDOW}))) AS n FROM p GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
q AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
c AS (
  SELECT doc_id, text, words, len(words) AS n_words,
    length(regexp_replace(text, '{blank}', '', 'g')) AS word_chars,
    length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
    coalesce(q.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM w LEFT JOIN q USING (rid) LEFT JOIN r USING (rid)),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, greatest(n_words, 1) AS m,
    length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines,
    length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) AS n_upper,
    length(text) - length(translate(text, '!?', '')) AS n_marks
  FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > m OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * m
    OR word_chars > 15 * m OR 2 * n_upper > greatest(word_chars, 1) OR 5 * n_marks > m
    OR 10 * len(list_distinct(words)) < least(m, sqrt(m * {VARIETY_WORDS}.0))) AS kept
FROM f
"""
