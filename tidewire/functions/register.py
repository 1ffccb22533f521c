"""Functions for SQL: what has no expression of its own there."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewire.functions.figures import FIGURE, figures_of
from tidewire.functions.terms import once_a_worker
from tidewire.operators.extract import Security, TickerFinder


def register(spark: SparkSession, securities: Sequence[Security] = ()) -> list[str]:
    """Registers Arrow-batched ``extract_figures`` and ``extract_tickers``; returns their names.

    Tokens, fingerprints, similarities and earnings are expressions of Spark
    (``tidewire.functions.text``, ``tidewire.operators.earnings``) and need none.
    """
    master, lexicon = list(securities), uuid.uuid4().hex
    names = ("kind", "raw", "value", "unit", "label")

    @F.pandas_udf(f"array<{FIGURE.simpleString()}>")
    def extract_figures(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [dict(zip(names, f)) for f in figures_of(t)])

    @F.pandas_udf("array<string>")
    def extract_tickers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = once_a_worker(lexicon, lambda: TickerFinder(master))
        for text in batches:
            yield text.map(lambda t: [x[0] for x in finder.find(t)])

    spark.udf.register("extract_figures", extract_figures)
    spark.udf.register("extract_tickers", extract_tickers)
    return ["extract_figures", "extract_tickers"]
