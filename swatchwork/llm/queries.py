"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from swatchwork.llm import chat, decontaminate, filteraudit, language, licenses, mixing, neardup, pages, perplexity, quality, repetition, runs, secretscan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repetition_rules": repetition.op1_repetition_rules,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_language_id": language.op3_language_id,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_chat_format": chat.op6_chat_format,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_lm_scores": perplexity.op8_lm_scores,
    "op9_main_text": pages.op9_main_text,
    "op10_near_duplicates": neardup.op10_near_duplicates,
    "op11_secret_scan": secretscan.op11_secret_scan,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_filter_audit": filteraudit.op13_filter_audit,
}
#: The others cannot be told in SQL; tests hold them against brute force or held-out labels.
ORACLE_SQL: dict[str, str] = {"op6_chat_format": chat.OP6_SQL, "op13_filter_audit": filteraudit.OP13_SQL}
