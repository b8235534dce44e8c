"""Corpus preparation: documents to packed token sequences.

Stages, each stored as Parquet and read again by the next:

1. quality: co-trained classifier; documents that it rejects go.
2. near_dedup: components of near copies (SimHash of op8, or an exact Jaccard similarity of 5-word shingles of 0.8 or more); one document of each, the one with the smallest doc_id, stays. Rows without a doc_id can't be told
   apart from their copies by it and stay.
3. substring_dedup: passages of 20 words or more that occurred earlier are cut out; documents of which nothing is left go.
4. decontaminate: documents with a twentieth of their words in benchmark passages go; from others such passages are cut out.
5. packing: pieces of documents in sequences of at most 2048 tokens.

All but the last return the columns they were given, whatever further ones are called; text and n_chars follow the cuts. Null and empty texts stay until the last stage packs their end ids; empty tables give empty results.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, near_copies, packing, quality, substring
from quillspark.llm.common import captured, delete, stored, table


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ... but for those that a stage looks at, so that none clashes with an operator's; and what each was called."""
    looked_at = {"doc_id", "text", "source", "lang", "n_chars"}
    names = {c if c in looked_at else f"c{k}": c for k, c in enumerate(docs.columns)}
    return docs.toDF(*names), names


def _renamed(df: DataFrame, names: dict[str, str], **changed: Column) -> DataFrame:
    return df.select(*[changed.get(c, F.col(c)).alias(name) for c, name in names.items()])


def _with_text(df: DataFrame, text: str, names: dict[str, str]) -> DataFrame:
    return _renamed(df, names, text=F.col(text), n_chars=F.coalesce(F.length(text), F.lit(0)).cast("long"))


#: What stages have stored for results that were not yet written when they returned, by session and input.
_left: dict[tuple[str, str], list[str]] = {}


def _stage(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that, before it begins, deletes what the one before it stored, as that one's result has been written by then; a folder that docs itself reads stays."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        old = _left.pop(key, [])
        read = docs.inputFiles() if old else []
        for folder in old:
            if not any(folder in file for file in read):
                delete(spark, folder)
        with captured() as made:
            out = stage(spark, docs, sf_dir)
        _left[key] = made
        return out

    return run


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, names = _numbered(docs)
    return _renamed(quality.score_quality(own, table(spark, sf_dir, "labels")).where("keep"), names)


@_stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, names = _numbered(docs)
    found = near_copies.near_copies(own)
    copies = stored(found.where("id <> component_id").select(F.col("id").alias("doc_id")).distinct(), "copies")
    return _renamed(own.join(near_copies.few(copies), "doc_id", "left_anti"), names)


@_stage
def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, names = _numbered(docs)
    cut = substring.dedup_substrings(own)
    return _with_text(cut.where("n_removed = 0 or n_removed < n_words"), "kept_text", names)


@_stage
def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, names = _numbered(docs)
    hits = decontaminate.find_hits(own, table(spark, sf_dir, "benchmark"), cleaned=True)
    return _with_text(hits.where("not contaminated"), "clean_text", names)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, remember=120_000)  # beside executors whose heaps have grown in the stages before


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]

#: A trained classifier, XXH64 fingerprints and a tokenizer are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents to packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
