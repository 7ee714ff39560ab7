"""Queries of the training-data operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandgraph.llm import bpe, exact_dedup, line_dedup, lm_score, mixing, near_dedup, pii, quality, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_minhash": near_dedup.op2_minhash,
        "op3_bpe": bpe.op3_bpe,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_mixing": mixing.op6_mixing,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_pii": pii.op8_pii,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_lm_score": lm_score.op10_lm_score,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.ORACLE, "op4_exact_dedup": exact_dedup.ORACLE, "op6_mixing": mixing.ORACLE}
