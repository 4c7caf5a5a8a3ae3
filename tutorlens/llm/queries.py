"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tutorlens.llm import alignment, decontaminate, embedding_dedup, language_id, lexical_search, license_scan, lm_scoring, mixing, ngram_join, secret_scan, sharding, substring_dedup, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_lm_scoring": lm_scoring.op2_lm_scoring,
        "op3_language_id": language_id.op3_language_id,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_secret_scan": secret_scan.op7_secret_scan,
        "op8_reshard": sharding.op8_reshard,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
        "op11_align_tokens": alignment.op11_align_tokens,
        "op12_license_scan": license_scan.op12_license_scan,
        "op13_lexical_search": lexical_search.op13_lexical_search,
        # parts of ops 4 and 8 that SQL can express
        "mix_targets": mixing.mix_targets,
        "shard_laws": sharding.shard_laws,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": ngram_join.ORACLE, "op6_decontaminate": decontaminate.ORACLE, "op9_substring_dedup": substring_dedup.ORACLE,
        "op12_license_scan": license_scan.oracle(), "op13_lexical_search": lexical_search.ORACLE,
        "mix_targets": mixing.TARGETS_ORACLE, "shard_laws": sharding.LAWS_ORACLE,
    }
