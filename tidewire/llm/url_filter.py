"""URL filters: a weighted vocabulary counted by Aho-Corasick, after host and path rules."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import read_table

#: A small sample of strict terms, one of which rejects a URL; give your own by ``read_vocabulary``.
STRICT = ("porn", "xxx", "hentai", "camgirl", "escort", "warez", "keygen", "casino", "jackpot", "phishing")
#: A small sample of soft terms, several different ones of which reject a URL.
SOFT = (
    "adult", "sex", "nude", "hot", "dating", "bet", "poker", "slots", "loan", "payday", "pills",
    "cheap", "free", "download", "torrent", "crack", "click", "track", "ref", "promo", "spam", "seo",
)
#: Weight of different soft terms that rejects; a soft term weighs 1 unless it is given another weight.
SOFT_WEIGHT = 2.0
#: Terms of a vocabulary, at most: tasks hold it whole.
MAX_TERMS = 1_000_000

#: (host, start of path, verdict): the rule of the longest host and path that fits decides.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

@dataclass(frozen=True)
class Vocabulary:
    """Strict terms, and soft terms with their weights; all in lower case."""

    strict: frozenset[str]
    soft: Mapping[str, float]

    @classmethod
    def of(cls, strict: Iterable[str], soft: Iterable[str] | Mapping[str, float]) -> Vocabulary:
        weights = soft if isinstance(soft, Mapping) else dict.fromkeys(soft, 1.0)
        hard = frozenset(t.lower() for t in strict if t)
        return cls(hard, {t.lower(): float(w) for t, w in weights.items() if t and t.lower() not in hard})


SAMPLE = Vocabulary.of(STRICT, SOFT)


def read_vocabulary(terms: DataFrame) -> Vocabulary:
    """From rows (``term``, ``strict``, ``weight``), of a table or a file: strict if told so, else soft with its weight (null: 1).

    Empty and null terms are left out; of a term given twice strict wins, then the
    greater weight.  More than ``MAX_TERMS`` are refused.
    """
    rows = terms.where(F.coalesce(F.col("term"), F.lit("")) != "").groupBy(F.lower("term").alias("term"))
    rows = rows.agg(F.max(F.coalesce("strict", F.lit(False))).alias("strict"), F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    found = rows.limit(MAX_TERMS + 1).collect()
    if len(found) > MAX_TERMS:
        raise ValueError(f"a vocabulary has at most {MAX_TERMS} terms")
    return Vocabulary.of((r.term for r in found if r.strict), {r.term: r.weight for r in found if not r.strict})


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits as struct(rule, verdict); null if none does."""
    found = None
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def count_terms(df: DataFrame, url: str, vocabulary: Vocabulary = SAMPLE) -> DataFrame:
    """Adds ``n_strict`` and ``n_soft`` (occurrences), ``n_soft_terms`` (different terms), their ``soft_weight`` and ``terms`` (those found, sorted).

    One Aho-Corasick automaton finds all terms in one reading of the lower-cased
    URL.  A term counts if neither neighbour is a letter or digit.  A null URL
    has none.
    """
    schema = df.schema
    known = df.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        strict, soft = known.value.strict, known.value.soft
        automaton = ahocorasick.Automaton()
        for term in (*strict, *soft):
            automaton.add_word(term, term)
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            counts: tuple[list, ...] = ([], [], [], [], [])
            for text in batch.column(url).to_pylist():
                n_strict = n_soft = 0
                seen = set()
                text = (text or "").lower()
                for end, term in automaton.iter(text) if len(automaton) else ():
                    start = end - len(term) + 1
                    if start and text[start - 1].isalnum() or text[end + 1 : end + 2].isalnum():
                        continue
                    seen.add(term)
                    n_strict += term in strict
                    n_soft += term in soft
                mild = [soft[t] for t in sorted(seen) if t in soft]
                for column, x in zip(counts, (n_strict, n_soft, len(mild), float(sum(mild)), sorted(seen))):
                    column.append(x)
            kinds_of = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(counts, kinds_of))], [*batch.schema.names, *COUNTS])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return df.mapInArrow(scan, ddl + ", n_strict long, n_soft long, n_soft_terms long, soft_weight double, terms array<string>")


#: What ``count_terms`` adds.
COUNTS = ("n_strict", "n_soft", "n_soft_terms", "soft_weight", "terms")


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, soft_weight: float = SOFT_WEIGHT, vocabulary: Vocabulary = SAMPLE
) -> DataFrame:
    """Judges ``url`` of each row of (``page_id``, ``url``); other columns are ignored.

    The rule that fits decides; without one, the vocabulary does: ``block`` on
    one strict term, or two different soft terms or more that weigh ``soft_weight`` together,
    else ``allow``.  Null and malformed URLs have an empty host and path, fit no
    rule, and are judged by their terms (null: none).  Repeated rows are judged
    alike, and each stays; an empty table gives an empty table.
    """
    rows = count_terms(pages.select("page_id", "url"), "url", vocabulary)
    rows = rows.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    rows = rows.withColumn("_rule", host_rule(F.col("host"), F.col("path"), rules))
    own = F.when((F.col("n_strict") > 0) | ((F.col("n_soft_terms") >= 2) & (F.col("soft_weight") >= soft_weight)), "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), own).alias("verdict"),
        "n_strict", "n_soft", "n_soft_terms", F.array_join("terms", ",").alias("terms"),
    )


def op3_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL."""
    return judge_urls(read_table(spark, sf_dir, "pages"))


def op3_sql() -> str:
    """The same in DuckDB: a term with boundaries is a whole run of letters and digits."""
    terms = [(t, True) for t in STRICT] + [(t, False) for t in SOFT]
    values = ", ".join(f"('{t}', {str(s).lower()})" for t, s in terms)
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
WITH terms(term, strict) AS (VALUES {values}),
rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
parts AS (
  SELECT page_id, url, lower(coalesce(url, '')) AS low,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
words AS (
  SELECT low, unnest(regexp_extract_all(low, '[\\pL\\pN]+')) AS word FROM (SELECT DISTINCT low FROM parts)),
found AS (SELECT low, term, strict, count(*) AS n FROM words JOIN terms ON word = term GROUP BY ALL),
counts AS (
  SELECT low, sum(n) FILTER (strict) AS n_strict, sum(n) FILTER (NOT strict) AS n_soft,
    count(*) FILTER (NOT strict) AS n_soft_terms, string_agg(term, ',' ORDER BY term) AS terms
  FROM found GROUP BY low),
hit AS (
  SELECT host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    max_by(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, host, path, rule,
  coalesce(rule_verdict, CASE WHEN coalesce(n_strict, 0) > 0 OR coalesce(n_soft_terms, 0) >= {SOFT_WEIGHT:.0f}
    THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(coalesce(n_strict, 0) AS BIGINT) AS n_strict, CAST(coalesce(n_soft, 0) AS BIGINT) AS n_soft,
  CAST(coalesce(n_soft_terms, 0) AS BIGINT) AS n_soft_terms, coalesce(terms, '') AS terms
FROM parts LEFT JOIN counts USING (low) LEFT JOIN hit USING (host, path)
"""
