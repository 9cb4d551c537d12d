"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, exact_dedup, jaccard_join, katz, language, lexical, line_dedup, lsh_forest, pii, resample, token_files, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.op1_pii,
        "op2_bpe": bpe.op2_bpe,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_language": language.op4_language,
        "op5_katz": katz.op5_katz,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_token_files": token_files.op9_token_files,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op11_resample": resample.op11_resample,
        "op12_lexical": lexical.op12_lexical,
        "op13_lsh_forest": lsh_forest.op13_lsh_forest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": decontaminate.OP3_SQL, "op7_exact_dedup": exact_dedup.OP7_SQL, "op10_jaccard_join": jaccard_join.OP10_SQL, "op11_resample": resample.OP11_SQL, "op12_lexical": lexical.OP12_SQL, "op13_lsh_forest": lsh_forest.OP13_SQL}
