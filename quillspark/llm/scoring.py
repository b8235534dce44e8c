"""Language-model scoring (operator 1): stupid backoff from the corpus's own n-gram counts.

Words are runs of other than ASCII white space, lower-cased in A-Z. Counts of all n-grams up to ``order`` are taken over all documents.
Each document is scored against the *other* documents: its own n-grams are taken off all counts, so that a text isn't praised
for being in the corpus. The score of a word after its context is count(n-gram) / count(context) for the longest n-gram
with a count left, times ``alpha`` for each word of context given up (of those that the document has); a single word has count / words in all other documents, and a word that is
nowhere else alpha**order / (those words + 1). ``log_score`` is the sum of natural logarithms.

Plan. Documents are dealt once by a hash, compressed, into blocks of a few MB. Each block explodes its n-grams into hashes and sums
them (a frequent n-gram is one entry a block, so none is hot); the entries are dealt by hash range, where they add up to the
count table; each block gets back what the others add to its own entries, in its entries' order. With more blocks than ``fan_out`` that
takes two steps (``common.Ranges``), so that entries travel in a number of cells in proportion to the blocks. The blocks then
look up every n-gram of their documents and sum by document.

Null texts have no words and log_score 0. Repeated documents are documents of their own, ids may be null or repeated. A very long text is part of one block.
An empty table gives an empty result. Other columns, whatever they are called, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import FAN_OUT, Ranges, cuts, doc_windows, hash_blocks, hasher, pack, pack_counts, quoted, table, texts, unpack, unpack_counts

ORDER = 3
ALPHA = 0.4
#: n-gram hashes keep 56 bits: a byte less for each entry that moves, and for 15 billion n-grams two thousand of them share an entry.
_BITS = np.uint64(0xFFFFFFFFFFFFFF00)
_TOTAL = np.zeros(1, np.uint64)  # the n-gram of no words: its count is the number of words
_CELL = {"bucket": pa.int32(), "block": pa.int32(), "hashes": pa.binary(), "counts": pa.binary()}


def _packed(docs: DataFrame, id_col: str, text_col: str, block: Column) -> DataFrame:
    """(id, z, block): texts compressed, as they move once and are read twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            z = [compress(t.encode("utf-8", "surrogatepass")) for t in texts(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary()), b.column(2)], ["id", "z", "block"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[quoted(id_col)].alias("id"), docs[quoted(text_col)].alias("text"), block.alias("block"))
    return picked.mapInArrow(run, f"id {kind}, z binary, block int")


def _block_words(column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes, parts = [], [np.empty(0, np.uint64)]
    unpacked = zstandard.ZstdDecompressor().decompress
    for z in column:
        words = unpacked(z).lower().split()
        sizes.append(len(words))
        parts.append(hasher.array(words))
    return np.concatenate(parts), np.array(sizes, np.int64)


def _ngrams(h: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, at = doc_windows(h, sizes, n)
    return (hashes ^ np.uint64(n * 0x2545F4914F6CDD1D % (1 << 64))) & _BITS, at


def block_counts(h: np.ndarray, sizes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct n-grams by rising hash, and how often it has each."""
    found = [np.unique(_ngrams(h, sizes, n)[0], return_counts=True) for n in range(1, order + 1)]
    hashes = np.concatenate([_TOTAL, *(f[0] for f in found)])
    counts = np.concatenate([[len(h)], *(f[1] for f in found)])
    by = np.argsort(hashes, kind="stable")
    return hashes[by], counts[by]


def _cells(rows: list[tuple], names: list[str]) -> pa.Table:
    """rows of the named columns as an Arrow table."""
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.table([pa.array(c, _CELL.get(n, pa.binary() if n == "others" else pa.int32())) for c, n in zip(columns, names)], names=names)


def count_cells(blocks: DataFrame, order: int, ranges: Ranges) -> DataFrame:
    """(bucket, block, hashes, counts): each block's n-gram counts by hash range."""

    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        hashes, counts = block_counts(*_block_words(t.column("z").to_pylist()), order)
        return _cells([(r, block, pack(hashes[i:j]), pack_counts(counts[i:j])) for r, i, j in cuts(hashes, ranges.first)], list(_CELL))

    return blocks.groupBy("block").applyInArrow(run, "bucket int, block int, hashes binary, counts binary")


def _sums(t: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some cells: where each but the first begins, all counts, the distinct hashes, each entry's place among those, their sums."""
    parts = [unpack(x) for x in t.column("hashes").to_pylist()]
    counts = np.concatenate([unpack_counts(x) for x in t.column("counts").to_pylist()])
    unique, place = np.unique(np.concatenate(parts), return_inverse=True)
    return np.cumsum([len(p) for p in parts])[:-1], counts, unique, place, np.bincount(place, weights=counts).astype(np.int64)


def ngram_totals(cells: DataFrame, ranges: Ranges) -> DataFrame:
    """(bucket, block, others): for each n-gram of a cell, in the cell's order, how often the other blocks have it."""

    def total(by: str):
        """Of one range's cells by block or part: the sums over all of them without their own."""

        def run(t: pa.Table) -> pa.Table:
            at, counts, _, place, sums = _sums(t)
            rest = [pack_counts(x) for x in np.split(sums[place] - counts, at)]
            return _cells(list(zip(t.column("bucket").to_pylist(), t.column(by).to_pylist(), rest)), ["bucket", by, "others"])

        return run

    if not ranges.two_steps:
        return cells.groupBy("bucket").applyInArrow(total("block"), "bucket int, block int, others binary")

    def up(t: pa.Table) -> pa.Table:
        _, _, hashes, _, sums = _sums(t)
        part = t.column("part")[0].as_py()
        return _cells([(r, part, pack(hashes[i:j]), pack_counts(sums[i:j])) for r, i, j in cuts(hashes, ranges.first * ranges.second)], ["bucket", "part", "hashes", "counts"])

    def down(left: pa.Table, right: pa.Table) -> pa.Table:
        at, counts, _, place, sums = _sums(left)
        finer = sorted(zip(right.column("bucket").to_pylist(), right.column("others").to_pylist()))
        sums = sums + np.concatenate([unpack_counts(x) for _, x in finer])  # rising ranges hold rising hashes
        rest = [pack_counts(x) for x in np.split(sums[place] - counts, at)]
        return _cells(list(zip(left.column("bucket").to_pylist(), left.column("block").to_pylist(), rest)), ["bucket", "block", "others"])

    grouped = cells.withColumn("part", ranges.part())
    of_parts = grouped.groupBy("bucket", "part").applyInArrow(up, "bucket int, part int, hashes binary, counts binary")
    got = of_parts.groupBy("bucket").applyInArrow(total("part"), "bucket int, part int, others binary")
    got = got.withColumn("first", F.floor(F.col("bucket") / ranges.second).cast("int"))
    return grouped.groupBy("bucket", "part").cogroup(got.groupBy("first", "part")).applyInArrow(down, "bucket int, block int, others binary")


def score_block(column: list, others: np.ndarray | None, order: int, alpha: float) -> dict[str, np.ndarray]:
    """Scores of one block's documents. others: what the other blocks add to the block's own counts, by rising hash."""
    h, sizes = _block_words(column)
    of = np.repeat(np.arange(len(sizes)), sizes)
    hashes, totals = block_counts(h, sizes, order)
    if others is not None:
        totals = totals + others

    def corpus(x: np.ndarray) -> np.ndarray:
        return totals[np.searchsorted(hashes, x)]

    rest = corpus(_TOTAL)[0] - sizes  # words in all other documents
    log_a = np.log(alpha)
    score, before, longest = np.zeros(len(h)), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    give = np.zeros(len(h))
    with np.errstate(divide="ignore", invalid="ignore"):
        for n in range(1, order + 1):
            grams, at = _ngrams(h, sizes, n)
            unique, inverse = np.unique(grams, return_inverse=True)
            _, which, times = np.unique(of[at] * max(1, len(unique)) + inverse, return_inverse=True, return_counts=True)
            left = np.zeros(len(h), np.int64)  # by the n-gram's last word: its count without its own document
            left[at + n - 1] = corpus(unique)[inverse] - times[which]
            if n == 1:
                unseen = order * log_a - np.log(rest + 1.0)
                score = np.where(left > 0, np.log(left) - np.log(rest)[of], unseen[of])
                give = np.where(left > 0, log_a, 0.0)  # the price of a word of context; an unseen word has paid it
            else:
                context = np.concatenate(([0], before))[: len(h)]
                inside = np.zeros(len(h), bool)
                inside[at + n - 1] = True
                # where a document is too short for the context there is none to give up
                score = np.where(left > 0, np.log(left) - np.log(context), np.where(inside, score + give, score))
            longest = np.where(left > 0, n, longest)
            before = left
    sums = np.bincount(of, weights=score, minlength=len(sizes))[: len(sizes)] if len(h) else np.zeros(len(sizes))
    full = np.bincount(of, weights=longest == order, minlength=len(sizes))[: len(sizes)] if len(h) else np.zeros(len(sizes))
    return {"n_words": sizes, "log_score": sums, "mean_log_score": np.where(sizes > 0, sums / np.maximum(sizes, 1), 0.0), "n_full_order": full.astype(np.int64)}


def score_documents(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """(id, n_words, log_score, mean_log_score, n_full_order: words whose longest n-gram had a count) of every row."""
    block, n = hash_blocks(docs, id_col, text_col, blocks)
    ranges = Ranges(n, fan_out)
    dealt = _packed(docs, id_col, text_col, block)
    totals = ngram_totals(count_cells(dealt, order, ranges), ranges)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cells = sorted(zip(right.column("bucket").to_pylist(), right.column("others").to_pylist()))
        others = np.concatenate([unpack_counts(x) for _, x in cells]) if cells else None
        out = score_block(left.column("z").to_pylist(), others, order, alpha)
        return pa.table([left.column("id"), *(pa.array(x) for x in out.values())], names=["id", *out])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, log_score double, mean_log_score double, n_full_order long"
    scored = dealt.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(run, schema)
    return scored.withColumnRenamed("id", id_col)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
