"""Document fingerprints (operator 6): bottom-k sketches of shingle hashes, in DataFrame functions alone.

A text's words are its runs of other than ASCII white space; its shingles are ``width`` consecutive words (a shorter text that
has words is one shingle). The sketch is the ``k`` smallest distinct 64-bit shingle hashes in ascending order. Sketches of parts merge
into the sketch of the whole (``merge``); they estimate distinct shingles (``distinct_shingles``), resemblance
(``resemblance``, exact for texts of up to k distinct shingles) and containment (``containment``).

Null texts count as empty; empty sketches resemble each other fully (1.0) and others not at all (0.0). Equal texts have equal
sketches, repeated rows and ids are each reported, a very long text has a sketch like any other, an empty table gives an empty result. The query looks at doc_id and text alone,
whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import block_column, table, unused

K = 128
WIDTH = 5
#: Blocks for each task, so that tasks have about as much as each other; block numbers that are ordered together.
FINER, LOT = 8, 4096
_SPACE = " \t\n\x0b\f\r"


def with_sketch(df: DataFrame, text: Column, name: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """df and the sketch of ``text`` (array of longs, ascending)."""
    words, hashes, shingles = f"{name}_words", f"{name}_hashes", f"{name}_shingles"
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    df = df.withColumn(words, F.when(bare != "", F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w))).drop(words)  # once a word, not once a shingle
    n = F.size(hashes) - (width - 1)
    rows = F.arrays_zip(*[F.slice(hashes, i + 1, n).alias(f"w{i}") for i in range(width)])
    df = df.withColumn(
        shingles,
        F.when(n >= 1, F.transform(rows, lambda r: F.xxhash64(r)))
        .when(F.size(hashes) > 0, F.array(F.xxhash64(F.col(hashes))))
        .otherwise(F.array().cast("array<bigint>")),
    ).drop(hashes)
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)).drop(shingles)


def merge(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def _union_share(a: Column | str, b: Column | str, within: Column | str | None, k: int) -> Column:
    """Of the bottom-k of the union, the share that both (over the share that ``within``) have."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return both / F.size(union if within is None else F.array_intersect(within, union))


def resemblance(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets, 0 to 1."""
    none = (F.size(a) == 0).cast("int") + (F.size(b) == 0).cast("int")
    return F.when(none == 2, F.lit(1.0)).when(none == 1, F.lit(0.0)).otherwise(_union_share(a, b, None, k))


def containment(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; an empty a is contained in all."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.coalesce(_union_share(a, b, a, k), F.lit(0.0)))


def distinct_shingles(a: Column | str, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the kth smallest hash's place in 0..1."""
    place = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def as_text(a: Column | str) -> Column:
    """The sketch as 16 hexadecimal digits a hash, in its order."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """(id, sketch, n_shingles) of each document."""
    return with_sketch(docs.select(id_col, text_col), F.col(text_col), "sketch", k, width).select(id_col, "sketch", distinct_shingles("sketch", k).alias("n_shingles"))


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id", by: str = "text", derive: Callable[[DataFrame], DataFrame] = lambda df: df, blocks: int | None = None) -> DataFrame:
    """docs and, as next_<c>, the columns of the document that follows by ascending id (equal ids by ``by``, or, if they are more than a block
    holds, by a hash of it first; null ids last, by a hash of it and then by it; after the last comes the first). ``derive`` adds columns that needn't be moved as they follow from the others.

    Documents are dealt once into ranges of ids, where a window finds the next one. The first document of each range is
    found in the same shuffled rows, and those few alone are sent to the range before."""
    block, of = unused(docs, "quill_block"), unused(docs, "quill_of")
    number, most = block_column(docs, id_col, by, blocks, parts=FINER)
    dealt = docs.withColumn(block, number).repartition(max(1, -(-most // FINER)), block)
    order = [F.col(id_col).asc_nulls_last(), F.col(by).asc_nulls_first()]
    firsts = dealt.groupBy(block).agg(F.min(F.struct(id_col, by, *[c for c in docs.columns if c not in (id_col, by)])).alias("x"))
    firsts = derive(firsts.select(block, *[F.col("x")[c].alias(c) for c in docs.columns])).select(block, F.struct(*columns).alias("row"))
    # The block that each block follows: among some thousand numbers at a time, and the first of each thousand among those
    lot = F.floor(F.col(block) / LOT)
    numbers = docs.select(number.alias(block)).distinct().withColumn("lot", lot)
    lots = numbers.groupBy("lot").agg(F.max(block).alias("last"))
    lots = lots.select("lot", F.lag("last").over(Window.orderBy("lot")).alias("before"), F.max("last").over(Window.partitionBy()).alias("last_of_all"))
    numbers = numbers.withColumn("within", F.lag(block).over(Window.partitionBy("lot").orderBy(block))).join(lots, "lot")
    numbers = numbers.select(block, F.coalesce("within", "before", "last_of_all").alias(of))
    after = firsts.join(numbers, block).select(F.col(of).alias(block), F.col("row").alias("after"))
    found = derive(dealt).withColumn("within", F.lead(F.struct(*columns)).over(Window.partitionBy(block).orderBy(*order))).join(after, block, "left")
    row = F.coalesce("within", "after")
    own = [c for c in found.columns if c not in ("within", "after", block)]
    return found.select(*own, *[row[c].alias(f"next_{c}") for c in columns])


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, half = F.length("text"), F.floor(F.length("text") / 2)
    pairs = with_next(docs, ["text", "sketch"], derive=lambda df: with_sketch(df, F.col("text"), "sketch"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    pairs = with_sketch(pairs.withColumn("edited", edited), F.col("edited"), "edited_sketch")
    return pairs.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("sketch").alias("fingerprint"),
        as_text("edited_sketch").alias("edited_fingerprint"),
        resemblance("sketch", "edited_sketch").alias("near_edited"),
        resemblance("sketch", "next_sketch").alias("near_next"),
        distinct_shingles("sketch").alias("n_shingles"),
    )
