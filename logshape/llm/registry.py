"""Queries of this package by name, and their SQL."""

from __future__ import annotations

from . import decontaminate, html_text, language, lm_score, mixing, near_dedup, quality, substring_dedup, toxicity, warc


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_quality_rules": quality.op3_quality_rules,
        "op4_language_id": language.op4_language_id,
        "op5_html_text": html_text.op5_html_text,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
        "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
        "op9_warc": warc.op9_warc,
        "op10_lm_score": lm_score.op10_lm_score,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.ORACLE_OP1,
        "op7_benchmark_decontamination": decontaminate.ORACLE_OP7,
        "op8_minhash_near_dedup": near_dedup.ORACLE_OP8,
        "op9_warc": warc.ORACLE_OP9,
    }
