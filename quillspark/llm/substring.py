"""Substring deduplication (operator 5): repeated passages of ``width`` words or more.

Words are maximal runs of other than ASCII white space, compared as they are (null text: none). A window is ``width``
consecutive words of one document. Windows whose word sequence also starts earlier (in a smaller doc_id, or earlier in the same
document) are repeats; the words that any repeat covers merge into maximal intervals and are removed. Windows are
judged on the input, not on what is left.

Plan. Documents are dealt once, compressed, into blocks, ranges of doc_id of a few MB. Each block hashes every window (Rabin-Karp
over 64-bit word hashes) and sends the sorted distinct hashes of each hash range on, each with a check of 24 bits by a second rolling hash; for each range
the hashes are counted over all blocks, and every block but the first that has a hash learns that it is a repeat there (nothing comes back for
the many windows that occur in one block only). With more blocks than ``fan_out`` that takes two steps (``common.Ranges``), so that cells
grow in proportion to the blocks. Blocks then join what they learned with their documents. A passage
in a million copies is one entry a block, so no key is hot. Text moves once, and some nine bytes a window.

A window counts as a repeat only if hash and check agree, so that of n windows n*n / 2**89 are removed wrongly in expectation: a third of one in
1.5e13 windows, those of some 100 TB.

Nulls and ties: rows with a null doc_id come after all others, by a hash of their text. Rows with the same doc_id are ordered by text (if they are more than a block holds: first by a hash of it),
and equal rows stay separate documents, the second one being a repeat of the first. Rows without words come back unchanged; a very long text is
part of one block; an empty table gives an empty result. Further columns pass through, but for those that are called, in any case, like an output.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import FAN_OUT, Ranges, block_column, cover, cuts, doc_windows, hasher, intervals, mix, others, pack, quoted, table, texts, unpack

WIDTH = 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NEW = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
#: Bytes of the second hash that go with each window.
CHECK_BYTES = 3
_CHECK_SEED = np.uint64(0xD6E8FEB86659FD93)
_CELL = "hashes binary, checks binary"


def _hashed(column: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes, parts = [], [np.empty(0, np.uint64)]
    for t in column:
        words = t.encode("utf-8", "surrogatepass").split()
        sizes.append(len(words))
        parts.append(hasher.array(words))
    return np.concatenate(parts), np.array(sizes, np.int64)


def _windows(h: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, checks, index of the first word) of all windows within documents."""
    hashes, at = doc_windows(h, sizes, width)
    second, _ = doc_windows(mix(h ^ _CHECK_SEED), sizes, width)
    return hashes, (second >> np.uint64(64 - 8 * CHECK_BYTES)).astype(np.uint32), at


def _order(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order by hash and check, and which in that order are the same as the one before."""
    order = np.argsort(hashes, kind="stable")
    h, c = hashes[order], checks[order]
    same, agree = h[1:] == h[:-1], c[1:] == c[:-1]
    if (same & ~agree).any():  # colliding hashes: hardly ever
        order = np.lexsort((checks, hashes))
        h, c = hashes[order], checks[order]
        same, agree = h[1:] == h[:-1], c[1:] == c[:-1]
    return order, np.concatenate((np.zeros(min(1, len(hashes)), bool), same & agree))


def _distinct(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, check), by rising hash and check."""
    order, again = _order(hashes, checks)
    order = order[~again]
    return hashes[order], checks[order]


def _is_in(hashes: np.ndarray, checks: np.ndarray, known: np.ndarray, known_checks: np.ndarray) -> np.ndarray:
    """Whether each (hash, check) is among the known ones, which are distinct and by rising hash and check."""
    lo, hi = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
    found = np.zeros(len(hashes), bool)
    for step in range(int((hi - lo).max(initial=0))):  # one, but for colliding hashes
        at = np.flatnonzero(lo + step < hi)
        found[at] |= known_checks[lo[at] + step] == checks[at]
    return found


def _pack_checks(checks: np.ndarray) -> bytes:
    return np.ascontiguousarray(checks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :CHECK_BYTES]).tobytes()


def _unpack_checks(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // CHECK_BYTES, 4), np.uint8)
    out[:, :CHECK_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, CHECK_BYTES)
    return out.view("<u4").ravel()


def _rows(numbers: dict[str, list[int]], entries: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    columns = {k: pa.array(v, pa.int32()) for k, v in numbers.items()}
    columns["hashes"] = pa.array([pack(h) for h, _ in entries], pa.binary())
    columns["checks"] = pa.array([_pack_checks(c) for _, c in entries], pa.binary())
    return pa.table(columns)


def _entries(t: pa.Table, by: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, checks, number in column ``by``, rising) of all entries of some cells."""
    t = t.sort_by(by) if by else t
    parts = [np.empty(0, np.uint64), *map(unpack, t.column("hashes").to_pylist())]
    checks = [np.empty(0, np.uint32), *map(_unpack_checks, t.column("checks").to_pylist())]
    of = np.repeat([0, *t.column(by).to_pylist()], [len(p) for p in parts]) if by else np.empty(0, np.int64)
    return np.concatenate(parts), np.concatenate(checks), of


def _again(hashes: np.ndarray, checks: np.ndarray, of: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Of entries of blocks (``of``, in rising order): for each block those that an earlier one has too."""
    order, again = _order(hashes, checks)
    again = order[again]
    again = again[np.argsort(of[again], kind="stable")]  # by block, then by rising hash and check
    blocks, at = np.unique(of[again], return_index=True)
    return [(int(b), hashes[x], checks[x]) for b, x in zip(blocks, np.split(again, at[1:]))]


def window_cells(blocks: DataFrame, width: int, ranges: Ranges) -> DataFrame:
    """(bucket, block, hashes, checks): the distinct window hashes of each block and hash range, packed."""

    def run(t: pa.Table) -> pa.Table:
        hashes, checks = _distinct(*_windows(*_hashed(_texts_of(t)), width)[:2])
        cells = cuts(hashes, ranges.first)
        return _rows({"bucket": [r for r, _, _ in cells], "block": [t.column("block")[0].as_py()] * len(cells)}, [(hashes[i:j], checks[i:j]) for _, i, j in cells])

    return blocks.groupBy("block").applyInArrow(run, f"bucket int, block int, {_CELL}")


def repeats(cells: DataFrame, ranges: Ranges) -> DataFrame:
    """(block, hashes, checks): of each block, the windows that an earlier block has too."""

    def first_of(by: str, kept: list[str]):
        def run(t: pa.Table) -> pa.Table:
            found = _again(*_entries(t, by))
            return _rows({k: [f[0] if k == by else t.column(k)[0].as_py() for f in found] for k in kept}, [f[1:] for f in found])

        return run

    if not ranges.two_steps:
        return cells.groupBy("bucket").applyInArrow(first_of("block", ["block"]), f"block int, {_CELL}")

    def up(t: pa.Table) -> pa.Table:
        hashes, checks = _distinct(*_entries(t)[:2])
        finer = cuts(hashes, ranges.first * ranges.second)
        return _rows({"bucket": [r for r, _, _ in finer], "part": [t.column("part")[0].as_py()] * len(finer)}, [(hashes[i:j], checks[i:j]) for _, i, j in finer])

    def down(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes, checks, of = _entries(left, "block")
        known, known_checks = _entries(right)[:2]
        found = _again(np.concatenate((known, hashes)), np.concatenate((known_checks, checks)), np.concatenate((np.full(len(known), -1), of)))
        return _rows({"block": [f[0] for f in found]}, [f[1:] for f in found])

    grouped = cells.withColumn("part", ranges.part())
    of_parts = grouped.groupBy("bucket", "part").applyInArrow(up, f"bucket int, part int, {_CELL}")
    got = of_parts.groupBy("bucket").applyInArrow(first_of("part", ["bucket", "part"]), f"bucket int, part int, {_CELL}")
    got = got.withColumn("first", F.floor(F.col("bucket") / ranges.second).cast("int"))
    return grouped.groupBy("bucket", "part").cogroup(got.groupBy("first", "part")).applyInArrow(down, f"block int, {_CELL}")


def _texts_of(t: pa.Table) -> list[str]:
    unpacked = zstandard.ZstdDecompressor().decompress
    return ["" if z is None else unpacked(z).decode("utf-8", "surrogatepass") for z in t.column("z").to_pylist()]


def _packed(rows: DataFrame) -> DataFrame:
    """rows (..., text, block) with the text compressed (z), as it moves once and is read twice."""
    kept = T.StructType(rows.schema.fields[:-2])
    names = [*kept.names, "z", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            z = [None if t is None else compress(t.encode("utf-8", "surrogatepass")) for t in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(z, pa.binary()), b.column(len(kept) + 1)], names)

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("z", T.BinaryType()), T.StructField("block", T.IntegerType())]))


def dedup_substrings(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None, full: bool = True, fan_out: int = FAN_OUT) -> DataFrame:
    """docs' columns, and: n_words, n_removed, kept_words (kept words joined by one space); with ``full`` also
    removed_spans (maximal intervals of word positions) and kept_text (the text without the removed words, its other
    white space as it was; null stays null)."""
    block, n = block_column(docs, id_col, text_col, blocks)
    ranges = Ranges(n, fan_out)
    names = ["n_words", "n_removed", "kept_words"] + (["removed_spans", "kept_text"] if full else [])
    passed = others(docs, names) if full else [id_col]
    # columns go by numbers within, so that no name clashes; the text itself comes back from its compressed form
    inner = docs.select(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(passed) if c != text_col], F.col(quoted(id_col)).alias("key"), F.col(quoted(text_col)).alias("text"), block.alias("block"))
    dealt = _packed(inner)
    earlier = repeats(window_cells(dealt, width, ranges), ranges)  # on the very rows that come below, so that they move once
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kinds = [T.LongType(), T.LongType(), T.StringType(), span, T.StringType()]
    schema = T.StructType([*[T.StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(passed)], *[T.StructField(n, k) for n, k in zip(names, kinds)]])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        column = [None if z is None else t for z, t in zip(left.column("z").to_pylist(), _texts_of(left))]
        keys = left.column("key").to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] or 0, column[i] is None, column[i] or ""))
        left, column = left.take(pa.array(order, pa.int64())), [column[i] for i in order]
        h, sizes = _hashed(texts(column))
        hashes, checks, at = _windows(h, sizes, width)
        order, same = _order(hashes, checks)
        again = np.zeros(len(hashes), bool)
        again[order[same]] = True  # all but the first in this block
        known = _distinct(*_entries(right)[:2])
        gone = cover(at[again | _is_in(hashes, checks, *known)], width, len(h))
        rows, i = [], 0
        for t, size in zip(column, sizes.tolist()):
            mask = gone[i : i + size]
            i += size
            n_gone = int(mask.sum())
            if not n_gone:
                rows.append([size, 0, _words_joined(t)] + ([[], t] if full else []))
                continue
            words = [m.group() for m in _WORD.finditer(t)]
            row = [size, n_gone, " ".join([w for w, g in zip(words, mask.tolist()) if not g])]
            if full:
                runs = intervals(mask)
                places = [m.span() for m in _WORD.finditer(t)]
                out, last = [], 0
                for a, b in runs:
                    out.append(t[last : places[a][0]])
                    last = places[b][0] if b < size else places[b - 1][1]
                row += [[{"start": a, "end": b} for a, b in runs], "".join([*out, t[last:]])]
            rows.append(row)
        new = [pa.array([r[k] for r in rows], t) for k, t in enumerate(_NEW[: len(names)])]
        own = [pa.array(column, pa.string()) if c == text_col else left.column(f"c{k}") for k, c in enumerate(passed)]
        return pa.table([*own, *new], names=schema.names)

    out = dealt.groupBy("block").cogroup(earlier.groupBy("block")).applyInArrow(run, schema)
    return out.toDF(*passed, *names)


def _words_joined(t: str | None) -> str:
    return b" ".join((t or "").encode("utf-8", "surrogatepass").split()).decode("utf-8", "surrogatepass")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"), full=False)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_words").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB: windows as word lists, the first occurrence of each by (doc_id, position).
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20
), s AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(w[i:i + 19], ' ')) ORDER BY doc_id, i) AS k FROM p
), g AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS gone FROM s WHERE k > 1 GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g ON d.doc_id = g.doc_id
), u AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), gu AS (
  SELECT doc_id, unnest(gone) AS i FROM g
), kw AS (
  SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS t FROM u ANTI JOIN gu ON u.doc_id = gu.doc_id AND u.i = gu.i GROUP BY u.doc_id
)
SELECT k.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM kept k LEFT JOIN kw ON k.doc_id = kw.doc_id
"""
