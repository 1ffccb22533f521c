"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import (
    decontaminate,
    jaccard_join,
    merkle,
    packing,
    pii,
    preference,
    quality,
    ranked_search,
    secrets,
    sharding,
    token_files,
    url_filter,
    warc,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_preference_chat": preference.op1_preference_chat,
        "op2_benchmark_windows": decontaminate.op2_benchmark_windows,
        "op3_url_vocabulary": url_filter.op3_url_vocabulary,
        "op4_rendezvous_sharding": sharding.op4_rendezvous_sharding,
        "op5_token_files": token_files.op5_token_files,
        "op6_token_efficiency": secrets.op6_token_efficiency,
        "op7_pii_surrogates": pii.op7_pii_surrogates,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_quality_cascade": quality.op9_quality_cascade,
        "op10_retrieval_packing": packing.op10_retrieval_packing,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_warc_source": warc.op12_warc_source,
        "op13_threshold_search": ranked_search.op13_threshold_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_preference_chat": preference.op1_sql(),
        "op2_benchmark_windows": decontaminate.op2_sql(),
        "op3_url_vocabulary": url_filter.op3_sql(),
        "op8_jaccard_join": jaccard_join.op8_sql(),
        "op9_quality_cascade": quality.op9_sql(),
        "op11_merkle_manifest": merkle.op11_sql(),
        "op12_warc_source": warc.op12_sql(),
        "op13_threshold_search": ranked_search.op13_sql(),
    }
