"""A training corpus from raw documents: quality rules, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last
return the columns of ``documents``.  A stage's table is written to the shared
folder and read again as the next one's documents, so that each stage works on
all that the one before kept, and a lost executor costs one stage's tasks at most.
Columns of any name are returned as they came, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, jaccard_join, packing, pii, quality
from tidewire.llm.common import materialize, put_aside, read_table
from tidewire.llm.tokenization import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null, empty and blank texts go, equal texts fare alike."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard index of 0.75 or more, the one of the least id (nulls last), then of the least hash of text.

    Rows are told apart by id and text: different texts under one id all stay.
    """
    return jaccard_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are passages of the benchmark; an empty benchmark takes none."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; ``n_chars`` follows the text, null texts stay null."""
    rows, own = put_aside(docs, pii.ADDED)
    replaced = pii.replace_pii(rows, pii.session_key(spark))
    if "n_chars" in docs.columns:
        length = F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
        replaced = replaced.withColumn("n_chars", F.when(F.col("n_entities") > 0, length).otherwise(F.col("n_chars")))
    return replaced.select(*own)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences of 4096 ids, with the ids; repeated and null ids are documents of their own."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Retrieval, tokens and keyed surrogates are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over the documents of a folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
