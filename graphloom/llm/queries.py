"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import ann_search, decontamination, html_extraction, jaccard_join, language_id, mixing, quality_classifier, substring_dedup, suffix_dedup, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_language_id": language_id.op3_language_id,
        "op4_decontamination": decontamination.op4_decontamination,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_mixing": mixing.op6_mixing,
        "op7_ann_search": ann_search.op7_ann_search,
        "op8_html_extraction": html_extraction.op8_html_extraction,
        "op9_quality": quality_classifier.op9_quality,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": substring_dedup.ORACLE_SQL,
        "op4_decontamination": decontamination.ORACLE_SQL,
        "op5_jaccard_join": jaccard_join.ORACLE_SQL,
        "op6_mixing": mixing.ORACLE_SQL,
    }
