"""Scalar and table functions for SQL text. They are SQL expressions that Catalyst inlines, not Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "quill_tokens": (
        "t STRING",
        "ARRAY<STRING>",
        r"regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+', 0)",
    ),
    "quill_token_count": (
        "t STRING",
        "INT",
        r"greatest(1, regexp_count(t, '[A-Za-z0-9_]+') + regexp_count(t, '[\\x{4e00}-\\x{9fff}]'))",
    ),
    "quill_slug": (
        "t STRING",
        "STRING",
        r"coalesce(nullif(regexp_replace(regexp_replace(lower(t), '[^a-z0-9\\x{4e00}-\\x{9fff}]+', '_'), '^_+|_+$', ''), ''), 'unknown')",
    ),
    "quill_overlap": (
        "q ARRAY<STRING>, t STRING",
        "DOUBLE",
        r"coalesce(try_divide(cast(size(array_intersect(q, regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+', 0))) AS double), sqrt(size(regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+', 0)))), 0.0D)",
    ),
    "quill_spoiler_level": ("chapter BIGINT", "INT", "CASE WHEN chapter <= 1 THEN 0 WHEN chapter <= 3 THEN 1 ELSE 2 END"),
    "quill_visible": (
        "chapter BIGINT, paragraph BIGINT, max_chapter BIGINT, max_paragraph BIGINT",
        "BOOLEAN",
        "chapter < max_chapter OR (chapter = max_chapter AND (max_paragraph IS NULL OR paragraph <= max_paragraph))",
    ),
}


#: Table functions, for FROM and LATERAL.
TABLES = {
    "quill_paragraphs": (
        "t STRING",
        "paragraph_index BIGINT, text STRING",
        "SELECT pos + 1, p FROM (SELECT posexplode(filter(transform(split(t, '\\n'), x -> btrim(x)), x -> x <> '')) AS (pos, p))",
    ),
    "quill_ngrams": (
        "t STRING, n INT",
        "position BIGINT, ngram STRING",
        "SELECT i, substring(t, i, n) FROM (SELECT explode(CASE WHEN length(t) >= n AND n > 0 THEN sequence(1, length(t) - n + 1) ELSE array() END) AS i)",
    ),
    "quill_windows": (
        "items ARRAY<STRING>, width INT, step INT",
        "window_index BIGINT, items ARRAY<STRING>",
        "SELECT (i - 1) DIV step + 1, slice(items, i, width) FROM (SELECT explode(CASE WHEN size(items) > 0 THEN sequence(1, size(items), step) ELSE array() END) AS i)",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to this session; returns their names."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    for name, (arguments, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN {body}")
    return [*FUNCTIONS, *TABLES]
