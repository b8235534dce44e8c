"""Token matrices (operator 3): best-fit-decreasing packing into rows of ``capacity`` token ids.

A document is its token ids and the end id; one longer than ``capacity`` is split into whole rows and a rest, so that no id is lost. Within a block of
about ``block_tokens`` ids, pieces go by falling length each into the row with the least room that suffices, found by a segment
tree over the capacities. Each row comes with what attention kernels need: ids as little-endian unsigned values (``dtype``: 32 bits, or 16 where the vocabulary allows it) padded
to the capacity, cumulative segment lengths, and positions that restart with each segment (padding counts on from 0).
``write_matrices`` writes the rows as Parquet and ``read_matrix`` makes arrays of them.

Blocks are packed within the tasks that read them: nothing is shuffled, and memory is one block and one document. ``row_id`` is the task's number * 2**40 and a
count. Null or empty texts are the end id alone; repeated documents are packed again; a very long text is split into whole rows and a rest; ties in length keep the order of arrival.
A null doc_id stays null. An empty table gives an empty result. Other columns, whatever they are called, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import quoted, table, texts
from quillspark.llm.tokens import PIECES, VOCABULARY, encoder

CAPACITY = 2048
BLOCK_TOKENS = 2_000_000
SCHEMA = "row_id long, n_tokens long, doc_ids array<long>, starts array<long>, lengths array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"


class RoomTree:
    """How many rows have room r, for r from 0 to capacity, as a segment tree; finds the least room that suffices."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, need: int) -> int | None:
        """The least room of at least ``need`` that any row has."""
        i = need + self.leaves
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:  # a right sibling with rows: its leftmost
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of indices of ``lengths``, by best fit decreasing; ties in the given order."""
    tree, rows, by_room = RoomTree(capacity), [], {}
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[i]
        room = tree.least(n)
        if room is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            row = by_room[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        by_room.setdefault(room - n, []).append(row)
        tree.add(room - n, 1)
    return rows


def pack_matrices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, pad_id: int = 0, vocabulary: str = VOCABULARY, remember: int = PIECES, block_tokens: int = BLOCK_TOKENS, dtype: str = "<u4") -> DataFrame:
    """One row a matrix row: row_id, n_tokens, doc_ids, starts, lengths, cu_seqlens, input_ids, position_ids."""
    end = np.array([end_id], "<u4").tobytes()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.int32()), pa.binary(), pa.binary()]
    most = np.iinfo(dtype).max
    if capacity > most or max(end_id, pad_id) > most:
        raise ValueError(f"capacity and ids must fit {dtype}")
    count = np.arange(capacity, dtype=dtype)

    def emit(pieces: list[tuple], first: int) -> Iterator[pa.RecordBatch]:
        rows = best_fit([p[2] for p in pieces], capacity)
        for k in range(0, len(rows), 128):
            out = []
            for j, row in enumerate(rows[k : k + 128]):
                parts = [pieces[i] for i in row]
                lengths = [p[2] for p in parts]
                ends = np.cumsum([0, *lengths])
                pad = capacity - int(ends[-1])
                ids = b"".join([*(p[3] for p in parts), np.full(pad, pad_id, "<u4").tobytes()])
                if dtype != "<u4":
                    wide = np.frombuffer(ids, "<u4")
                    if wide.max() > most:
                        raise ValueError(f"id {wide.max()} does not fit {dtype}")
                    ids = wide.astype(dtype).tobytes()
                positions = np.concatenate([count[:n] for n in [*lengths, pad]]).tobytes()
                out.append((first + k + j, int(ends[-1]), [p[0] for p in parts], [p[1] for p in parts], lengths, ends.tolist(), ids, positions))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id, enc = TaskContext.get().partitionId() << 40, encoder(vocabulary, remember)
        pieces, held = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(texts(part.column(1).to_pylist()))):
                    ids += end
                    for at in range(0, len(ids) // 4, capacity):
                        x = ids[4 * at : 4 * (at + capacity)]
                        pieces.append((doc, at, len(x) // 4, x))
                    held += len(ids) // 4
                if held >= block_tokens:
                    for rows in emit(pieces, next_id):
                        next_id += rows.num_rows
                        yield rows
                    pieces, held = [], 0
        if pieces:
            yield from emit(pieces, next_id)

    picked = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    return picked.mapInArrow(run, SCHEMA)


def write_matrices(matrices: DataFrame, path: str) -> None:
    """Parquet files, one row a matrix row."""
    matrices.write.mode("errorifexists").parquet(path)


def read_matrix(row, dtype: str = "<u4") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, positions, cumulative segment lengths) of one row."""
    return np.frombuffer(row["input_ids"], dtype), np.frombuffer(row["position_ids"], dtype), np.array(row["cu_seqlens"], np.int32)


def op3_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrices themselves, 16 bits an id and position: the vocabulary has under 65,536 ids."""
    return pack_matrices(table(spark, sf_dir, "documents"), dtype="<u2")
