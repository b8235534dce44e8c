"""The training-data operators as queries over whole tables, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontaminate, fingerprint, language, matrices, packing, quality, scoring, simhash, substring, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": scoring.op1_lm_score,
    "op2_quality": quality.op2_quality,
    "op3_token_matrices": matrices.op3_token_matrices,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_substring_dedup": substring.op5_substring_dedup,
    "op6_fingerprints": fingerprint.op6_fingerprints,
    "op7_language_id": language.op7_language_id,
    "op8_simhash": simhash.op8_simhash,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_harmonic_packing": packing.op10_harmonic_packing,
}

SQL: dict[str, str] = {
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op5_substring_dedup": substring.OP5_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
}
