"""Harmonic packing (operator 10): documents into sequences of at most ``capacity`` tokens.

A document is its token ids and the end id. A document of length r up to the capacity is in class k = capacity // r, that is r lies in (capacity / (k + 1), capacity / k], and each
bin of class k takes exactly k documents, whole. A longer one gives whole sequences first; what remains of it is *sand*, which may be cut as it is already.
The room that the k documents of a bin leave is filled with sand, cut to fit; room of fewer than ``smallest`` tokens is padded. While bins wait for sand
of a whole sequence or more, the next document becomes sand, so that about one cut a bin is all that padding costs. Every task fills its
own bins, so nothing is shuffled and a lost task is simply run again with the same result.

At its end a task has at most one open bin a class, bins that wait and some sand. Those pieces are strung together and cut into whole
sequences and then powers of two, which are not padded. ``sequence_id`` is the task's number * 2**40 and a count.

Null or empty texts are the end id alone. Repeated documents are packed again. A null doc_id stays null. A very long text is held once, as ids. An empty table gives an empty result. Memory is one batch of
texts, the open bins (a sequence a class at most) and those that wait (a sequence for each ``smallest`` tokens of a sequence at most). Other columns, whatever they are called, are not looked at.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import quoted, table, texts
from quillspark.llm.tokens import PIECES, VOCABULARY, encoder

CAPACITY = 2048
SMALLEST = 8
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def size_class(n: int, capacity: int) -> int:
    """The class of a document of n tokens: how many of its length a sequence holds."""
    return capacity // n


class Packer:
    """Pieces are (doc_id, start, ids as bytes, doc_tokens)."""

    def __init__(self, first_id: int, capacity: int, smallest: int):
        self.next_id, self.capacity, self.smallest = first_id, capacity, smallest
        self.open: dict[int, list] = defaultdict(list)
        self.waiting: deque[tuple[int, list]] = deque()  # (room, pieces)
        self.sand: deque[tuple] = deque()
        self.needed = self.held = 0  # tokens that waiting bins lack; tokens of sand
        self.rows: list[tuple] = []

    def close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at, ids))
            at += n
        self.next_id += 1

    def fill(self, room: int, pieces: list) -> None:
        """Closes a bin with sand in its room; there must be enough."""
        self.held -= room
        while room:
            doc, start, ids, total = self.sand.popleft()
            n = min(room, len(ids) // 4)
            pieces.append((doc, start, ids[: 4 * n], total))
            if 4 * n < len(ids):
                self.sand.appendleft((doc, start + n, ids[4 * n :], total))
            room -= n
        self.close(pieces)

    def add(self, doc: int | None, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.capacity:
            self.close([(doc, at, ids[4 * at : 4 * (at + self.capacity)], total)])
            at += self.capacity
        if at == total:
            return
        piece = (doc, at, ids[4 * at :] if at else ids, total)
        if at or self.needed >= self.capacity:
            self.sand.append(piece)
            self.held += total - at
        else:
            k = size_class(total, self.capacity)
            bin_ = self.open[k]
            bin_.append(piece)
            if len(bin_) < k:
                return
            del self.open[k]
            room = self.capacity - sum(len(p[2]) for p in bin_) // 4
            if room < self.smallest:
                self.close(bin_)
                return
            self.waiting.append((room, bin_))
            self.needed += room
        while self.waiting and self.waiting[0][0] <= self.held:
            room, bin_ = self.waiting.popleft()
            self.needed -= room
            self.fill(room, bin_)

    def finish(self) -> None:
        left = [p for _, pieces in self.waiting for p in pieces] + [p for k in sorted(self.open) for p in self.open[k]] + [*self.sand]
        rest = sum(len(p[2]) for p in left) // 4
        i = at = 0
        while rest:
            room = min(self.capacity, 1 << (rest.bit_length() - 1))
            rest -= room
            pieces = []
            while room:
                doc, start, ids, total = left[i]
                n = min(room, len(ids) // 4 - at)
                pieces.append((doc, start + at, ids[4 * at : 4 * (at + n)], total))
                room, at = room - n, at + n
                if at == len(ids) // 4:
                    i, at = i + 1, 0
            self.close(pieces)
        self.open.clear()
        self.waiting.clear()
        self.sand.clear()


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, smallest: int = SMALLEST, end_id: int = END_ID, vocabulary: str = VOCABULARY, remember: int = PIECES, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids: and ids (binary)."""
    if capacity & (capacity - 1) or smallest > capacity:
        raise ValueError("capacity must be a power of two, and smallest at most as much")
    end = np.array([end_id], "<u4").tobytes()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + ([pa.array(columns[7], pa.binary())] if with_ids else [])
        return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, enc = Packer(TaskContext.get().partitionId() << 40, capacity, smallest), encoder(vocabulary, remember)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids = enc.encode(texts(part.column(1).to_pylist()))
                for doc, x in zip(part.column(0).to_pylist(), ids):
                    packer.add(doc, x + end)
                if packer.rows:
                    yield out(packer.rows)
                    packer.rows = []
        packer.finish()
        if packer.rows:
            yield out(packer.rows)

    picked = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    return picked.mapInArrow(run, SCHEMA + ", ids binary" * with_ids)


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
