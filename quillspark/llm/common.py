"""Helpers shared by the training-data operators.

Three ideas recur:

* word hashing on whole batches (``WordHasher``, ``window_hashes``), so that Python touches a word once
  and numpy does the rest;
* *blocks*: documents dealt into many parts of a few MB of text, measured, by a hash (``hash_blocks``) or by ranges of ``doc_id``
  (``block_column``; the order of blocks is then the order of ``doc_id``). A block fits in one task, and their number grows with the input;
* *cells*: for each block and hash range, the sorted 64-bit hashes that occur there, packed into one
  binary value. A hash that occurs a million times in a block is one entry, so that a frequent n-gram or passage
  never weighs more than one entry a block. A block's hashes are dealt into at most ``FAN_OUT`` ranges: beyond as many blocks, the cells
  of one range and of ``FAN_OUT`` blocks at a time are merged and dealt once more (``Ranges``), so that cells grow in proportion to blocks.
"""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Odd multiplier of the polynomial window hash; any odd 64-bit constant will do.
BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BLOCK_BYTES = 6 << 20
#: Most hash ranges that a block's hashes are dealt into at once; so a cell has a few KB at least.
FAN_OUT = 4096
#: Quantiles of doc_id that ranges of it are cut at; beyond as many blocks, each part between two of them is cut evenly by value.
LEAVES = 4096


_in_use: list = [None]


def _lean() -> None:
    """Lets a Python worker give large arrays back to the system as soon as they are free; else it keeps the most that any block has needed, stage after stage."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 19)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library, which may have its own way
        pass


def use(cache):
    """Marks the cache that this worker needs from now on and empties the one before: a worker that runs stage after stage holds one
    stage's cache at a time."""
    if _in_use[0] is not cache:
        _lean()
        if _in_use[0] is not None:
            _in_use[0].clear()
        _in_use[0] = cache
    return cache


#: Longer words are not remembered.
LONG_WORD = 200


class WordHasher(dict):
    """word (bytes) -> 64-bit hash. Keeps at most ``cap`` words and then starts anew, so its memory is bounded."""

    def __init__(self, cap: int = 150_000, seed: int = 0):
        super().__init__()
        self.cap, self.seed = cap, seed

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, self.seed)
        if len(word) <= LONG_WORD:
            if len(self) >= self.cap:
                self.clear()
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(use(self).__getitem__, words), np.uint64, len(words))


#: The words of all operators, one cache a worker.
hasher = WordHasher()


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h = h ^ (h >> np.uint64(27))
    h = h * _M2
    return h ^ (h >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power_arrays(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_powers.get("up", ())):
        size = max(n, 1 << 16)
        base, inverse = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
        for name, step in (("up", base), ("down", inverse)):
            p = np.full(size, step, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of each run of ``width`` consecutive values of ``h``: sum of h[i+j] * B**(width-1-j) modulo
    2**64, rolled along as a difference of prefix sums, then mixed. Empty if there are fewer values."""
    n = len(h)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = _power_arrays(n)
    sums = np.zeros(n + 1, np.uint64)
    np.add.accumulate(h * down, out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * up[width - 1 :])


def doc_windows(h: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that lie within one document. ``h``: word hashes of documents of ``sizes`` words, one after the
    other. Returns (hashes, index of each window's first word)."""
    hashes = window_hashes(h, width)
    if not len(hashes):
        return hashes, np.empty(0, np.int64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(h))  # words from here to the document's end
    at = np.flatnonzero(left[: len(hashes)] >= width)
    return hashes[at], at


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Boolean array of length n: inside any of the windows that begin at ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    edge[:n] += np.bincount(starts, minlength=n)[:n]
    ends = starts + width
    edge -= np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of True as half-open intervals."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit values as compressed byte planes of their differences; about 5.5 bytes a value."""
    deltas = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(deltas.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values in their order; small ones take a byte or less."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_counts(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def ranges_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash; the 64-bit space is split evenly into ``ranges`` (at most 2**31)."""
    return (((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def cuts(hashes: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of the non-empty ranges of a sorted array; takes time by its length, not by their number."""
    if not len(hashes):
        return []
    of = ranges_of(hashes, ranges)
    at = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(of)]))
    return list(zip(of[at[:-1]].tolist(), at[:-1].tolist(), at[1:].tolist()))


class Ranges:
    """How ``blocks`` blocks exchange cells by hash range: at once, or in two steps.

    At once: each block's hashes go to ``first`` = as many ranges as there are blocks. With more than ``fan_out`` blocks that would make
    blocks * blocks cells, so ``first`` is then ``fan_out``, and ``fan_out`` blocks make a *part*: the cells of one range and part are merged (about one block's worth)
    and dealt into ``second`` ranges each. Either way a block or part makes at most fan_out cells, and a group about one block's worth."""

    def __init__(self, blocks: int, fan_out: int = FAN_OUT):
        self.blocks, self.fan_out = blocks, fan_out
        self.two_steps = blocks > fan_out
        self.first = min(blocks, fan_out)
        self.second = -(-blocks // fan_out)

    def part(self) -> Column:
        return F.floor(F.col("block") / self.fan_out).cast("int")


def contains(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each of x is among sorted_values."""
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def count_blocks(df: DataFrame, text_bytes: int | None, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about ``block_bytes`` of text; small inputs make some for each core, but none of under a sixteenth of that."""
    size, cores = text_bytes or 0, df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // block_bytes), min(2 * cores, size // (block_bytes // 16)))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores if df has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(df: DataFrame, names: list[str]) -> list[str]:
    """df's columns but those called like one of ``names`` in any case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def _spread(*columns: str) -> Column:
    """0 to 1 by a hash of the columns and of the input's partition, so that not even equal rows all come together."""
    return (F.xxhash64(*[F.col(quoted(c)) for c in columns], F.spark_partition_id()).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)


def _share(spread: Column, parts: Column | int) -> Column:
    """Of ``parts`` equal parts of 0..1 the one that ``spread`` is in."""
    n = F.lit(parts) if isinstance(parts, int) else parts
    return F.least(F.floor(spread * n), n - 1).cast("int")


def hash_blocks(df: DataFrame, key: str, text: str, blocks: int | None = None) -> tuple[Column, int]:
    """(block number of a row, number of blocks) by a hash of key and text: no key and no group of copies comes into one block."""
    n = blocks or count_blocks(df, df.agg(F.sum(F.octet_length(F.col(quoted(text))))).first()[0])
    return F.coalesce(_share(_spread(key, text), n), F.lit(0)), n


def block_column(df: DataFrame, key: str, text: str, blocks: int | None = None, leaves: int = LEAVES, parts: int = 1) -> tuple[Column, int]:
    """(block number of a row, a bound on their number), a number from 0 that never falls as ``key`` (an integer) rises. Blocks are cut at
    quantiles of the key (one job), so that they have about as many rows each, however ids are spread. A key that is repeated over more than a block is dealt
    into several by a hash of text (and of the input's partition); rows without a key come last, in as many blocks again, by that hash.
    ``parts``: blocks for each ``BLOCK_BYTES`` of text, none of them under a 64th of that."""
    kind = df.schema[key].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{key} is {kind.simpleString()}; ids are integers")
    of = F.col(quoted(key)).cast("long")
    got = df.agg(
        F.percentile_approx(of, [i / leaves for i in range(leaves + 1)], 10 * leaves).alias("q"), F.sum(F.octet_length(F.col(quoted(text)))).alias("size")
    ).first()
    n = blocks or count_blocks(df, got["size"])
    n = n if blocks else max(n, min(parts * n, (got["size"] or 0) // (BLOCK_BYTES // 64)))
    spread = _spread(text)
    # never null, as Spark should see, too: a filter for nulls on one side of a join would keep an exchange from being used twice
    loose = F.coalesce(_share(spread, n), F.lit(0))
    q = got["q"]
    if not q:
        return loose, n
    steps = min(n, leaves)
    each = -(-n // steps)  # blocks between two of the steps' quantiles, cut by value
    low = [q[i * leaves // steps] for i in range(steps)]
    starts = sorted(set(low))
    first = [low.index(b) for b in starts]
    last = [a - 1 for a in first[1:]] + [steps - 1]  # of a key that is several quantiles, the last one begins what follows it
    ends = [*starts[1:], max(q[-1], starts[-1]) + 1]
    longs = [f"{max(1 - (1 << 63), min(v, (1 << 63) - 1))}L" for v in starts]

    def numbers(values: list[int]) -> Column:
        return F.expr("array(" + ", ".join(f"{max(1 - (1 << 63), min(v, (1 << 63) - 1))}L" for v in values) + ")")

    # Two looks at some sqrt(steps) bounds each
    group = max(1, math.isqrt(len(starts)))
    outer = F.size(F.filter(numbers(starts[::group]), lambda b: b <= of))
    inner_bounds = F.expr("array(" + ", ".join(f"array({', '.join(longs[i : i + group])})" for i in range(0, len(longs), group)) + ")")
    inner = F.size(F.filter(F.element_at(inner_bounds, F.greatest(outer, F.lit(1))), lambda b: b <= of))
    at = F.greatest(F.lit(1), (F.greatest(outer, F.lit(1)) - 1) * group + inner)  # from 1
    start, end = F.element_at(numbers(starts), at), F.element_at(numbers(ends), at)
    a, b = (F.element_at(numbers([x * each for x in xs]), at) for xs in (first, last))
    ahead = (of.cast("double") - start) / F.greatest(F.lit(1.0), end.cast("double") - start)
    by_value = b + F.greatest(F.lit(0), F.least(F.lit(each - 1), F.floor(ahead * each)))
    by_hash = a + F.least(F.floor(spread * (b - a + 1)), b - a)
    block = F.when((of == start) & (b > a), by_hash).otherwise(by_value).cast("int")
    return F.coalesce(F.when(of.isNull(), F.lit(steps * each) + loose).otherwise(block), F.lit(0)), (steps * each + n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master (one machine) gets a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_captured: list[list[str]] = []


@contextmanager
def captured() -> Iterator[list[str]]:
    """The folders of all tables that stored() writes meanwhile."""
    made: list[str] = []
    _captured.append(made)
    try:
        yield made
    finally:
        _captured[:] = [m for m in _captured if m is not made]


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/quillspark/{name}-{uuid.uuid4().hex}"
    for made in _captured:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if "/quillspark/" in folder:
            delete(df.sparkSession, folder)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps, a number of rounds that grows with the
    logarithm of a component's size.

    edges (u, v): pairs of longs, in any order, repeats and loops allowed. Returns (node, root): each node that
    is not itself the smallest of its component, and that smallest one. Only two numbers a round come to the driver."""

    def canonical(e: DataFrame) -> DataFrame:
        pairs = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        return pairs.where("u <> v").groupBy("u", "v").agg(F.lit(1).alias("one")).drop("one")

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        own = least.select("u", F.col("m").alias("v"))
        return e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)

    def digest(e: DataFrame) -> tuple:
        x = F.xxhash64("u", "v").cast("decimal(38,0)")
        return tuple(e.agg(F.count("*"), F.sum(x)).first())

    now = stored(canonical(edges), "edges")
    was = digest(now)
    for _ in range(most_rounds):
        step = stored(canonical(small(canonical(large(now)))), "edges")
        discard(now)
        now, sums = step, digest(step)
        if sums == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was = sums
    raise RuntimeError(f"components: not settled after {most_rounds} rounds")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column) -> list[str]:
    """The texts of an Arrow or pandas column; null becomes empty."""
    return [x if isinstance(x, str) else "" for x in column]
