"""The library's functions for users of SQL: text functions without Python, and a table function for chunks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult
from pyspark.sql import types as T

from tidewire.functions import text as X

#: What each function takes and gives; its body is read from the expression of the same name.
_FUNCTIONS = {
    "tidy_text": ("text STRING", "STRING"),
    "tokens_of": ("text STRING", "ARRAY<STRING>"),
    "significant_tokens": ("tokens ARRAY<STRING>", "ARRAY<STRING>"),
    "fingerprint_of": ("text STRING", "STRING"),
    "jaccard_of": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE"),
    "hash_similarity": ("a BIGINT, b BIGINT", "DOUBLE"),
}


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)


def _bodies() -> dict[str, str]:
    stop = _quoted(X.STOPWORDS)
    token = X.TOKEN.replace("\\", "\\\\")
    return {
        "tidy_text": "trim(regexp_replace(text, '[\\\\s\\\\u00a0\\\\u2000-\\\\u200a\\\\u2028\\\\u2029\\\\u202f\\\\u205f\\\\u3000\\\\ufeff]+', ' '))",
        "tokens_of": f"regexp_extract_all(regexp_replace(translate(lower(text), '‘’', '\\'\\''), '([a-z0-9])\\'s\\\\b', '$1'), '{token}', 0)",
        "significant_tokens": f"filter(tokens, t -> length(t) > 1 AND t NOT IN ({stop}))",
        "fingerprint_of": f"substring(sha2(array_join(array_sort(array_distinct(filter(tokens_of(text), t -> length(t) > 1 AND t NOT IN ({stop})))), ' '), 256), 1, 32)",
        "jaccard_of": "CASE WHEN size(array_union(a, b)) = 0 THEN 1.0D ELSE CAST(size(array_intersect(a, b)) AS DOUBLE) / size(array_union(a, b)) END",
        "hash_similarity": "1.0D - bit_count(a ^ b) / 64.0D",
    }


class Chunks:
    """``SELECT ... FROM t, LATERAL text_chunks(t.text, 2000)``: a row a piece, of at most so many characters, cut at white space where there is any."""

    @staticmethod
    def analyze(text: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        if not limit.isConstantExpression or not isinstance(limit.value, int) or limit.value < 1:
            raise ValueError("the limit is a constant of 1 or more")
        return AnalyzeResult(T.StructType().add("place", T.IntegerType()).add("piece", T.StringType()))

    def eval(self, text: str | None, limit: int) -> Iterator[tuple[int, str]]:
        rest, place = (text or "").strip(), 0
        while rest:
            cut = len(rest)
            if cut > limit:
                # The last white space that leaves a piece of the limit's length, or the limit itself.
                cut = next((i for i in range(limit, 0, -1) if rest[i].isspace()), limit)
            piece, rest = rest[:cut].strip(), rest[cut:].strip()
            if piece:
                yield place, piece
                place += 1


def register_sql(spark: SparkSession) -> list[str]:
    """Creates the functions for this session; returns their names.  All but ``text_chunks`` are expressions that Spark compiles."""
    bodies = _bodies()
    for name, (takes, gives) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {bodies[name]}")
    spark.udtf.register("text_chunks", F.udtf(Chunks))
    return [*_FUNCTIONS, "text_chunks"]
