"""Persona knowledge bases and the source registry as set-oriented plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

# How early sources of a kind are retrieved, and how much their snippets weigh.
PRIORITY = {"work": 1, "voice": 2, "biography": 3}
WEIGHT = {"bio": 0.9, "era": 0.7, "style": 1.0, "boundary": 0.8, "theme": 1.1}


def by_kind(kind: Column, values: dict, other) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out.otherwise(other)


def source_documents(catalog: DataFrame) -> DataFrame:
    """catalog (persona, kind, title, ord) -> ranked source documents with a retrieval priority."""
    doc = F.concat_ws(":", "persona", "kind", T.slugify("title", fallback="item"), "ord")
    return catalog.select("persona", "kind", "title", doc.alias("source_id"), by_kind(F.col("kind"), PRIORITY, 9).cast("long").alias("priority"))


def snippets(profiles: DataFrame) -> DataFrame:
    """profiles (persona, bio, era, style, boundary, themes array) -> (persona, kind, text, weight): one typed snippet a field."""
    single = profiles.select("persona", F.expr("stack(4, 'bio', bio, 'era', era, 'style', style, 'boundary', boundary) as (kind, text)"))
    themes = profiles.select("persona", F.lit("theme").alias("kind"), F.explode("themes").alias("text"))
    rows = single.unionByName(themes).where("text is not null and text <> ''")
    return rows.withColumn("weight", by_kind(F.col("kind"), WEIGHT, 0.5))


def normalized_records(raw: DataFrame, defaults: dict[str, str], cli: dict[str, str | None], enums: dict[str, list[str]]) -> DataFrame:
    """Each field from the command line, else the record, else the default; a value outside its enum raises."""
    out = raw
    for name, default in defaults.items():
        bare = F.nullif(F.trim(F.regexp_replace(F.col(name).cast("string"), "^﻿", "")), F.lit(""))
        value = F.coalesce(F.lit(cli.get(name)), bare, F.lit(default))
        if name in enums:
            value = F.when(value.isin(*enums[name]), value).otherwise(F.raise_error(F.concat(F.lit(f"{name}: "), value)))
        out = out.withColumn(name, value)
    return out


def text_stats(text: Column) -> list[Column]:
    lines = F.size(F.split(text, "\n"))
    return [F.length(text).cast("long").alias("chars"), lines.cast("long").alias("lines"), F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"(?im)^\s*chapter[\s_-]*\d+"))).cast("long").alias("chapters")]
