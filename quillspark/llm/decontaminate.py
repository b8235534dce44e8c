"""Benchmark decontamination (operator 4).

Texts are lower-cased in A-Z and split into words, runs of letters, digits and all characters beyond ASCII. A window is ``width``
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A document word inside
any occurrence of a window is hit. A document is contaminated if it has hits and n_hit / n_words is at least ``share``.

The windows' hashes are broadcast; documents are scanned without a shuffle: rolling hashes of all their windows are
looked up, and each hit is verified word by word. Only ``shard_chars`` characters of benchmark text are broadcast at
a time. A larger benchmark is dealt by hash into as many shards as that takes, long items in segments of ``SEGMENT`` words that overlap by a window less one. Its shards are scanned for one after the
other: what is found is written to the shared folder before the next shard's index is made, so that no task ever holds two.

Null texts have no words (items: no windows). Repeated documents are each reported; repeated items count by id, and
items with a null id make hits but are in no list. Ids are compared as strings. An empty benchmark hits nothing, an empty table gives an empty result, very long texts are scanned whole. Other columns pass through, but for those
that are called, in any case, like an output.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import contains, cover, discard, doc_windows, hasher, intervals, others, quoted, stored, table

WIDTH = 13
SHARE = 0.05
SHARD_CHARS = 1_000_000
SEGMENT = 4096
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # what stands between words, in texts that are not lower-cased
_WORD = re.compile(f"[^{_BETWEEN}]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class WindowIndex:
    """The windows of some items: by length, their sorted hashes; by their words, the items."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        self.items: dict[bytes, set[str]] = {}
        lengths: dict[int, set[int]] = {}
        for item, text in items:
            words = words_of(text)
            n = min(width, len(words))
            if not n:
                continue
            hashes, at = doc_windows(hasher.array(words), np.array([len(words)]), n)
            lengths.setdefault(n, set()).update(hashes.tolist())
            for i in at.tolist():
                self.items.setdefault(b" ".join(words[i : i + n]), set()).update([] if item is None else [item])
        self.hashes = {n: np.sort(np.array(list(h), np.uint64)) for n, h in lengths.items()}

    def scan(self, docs: list[list[bytes]]) -> tuple[np.ndarray, list[set[str]]]:
        """For documents, one after the other: which of their words are hit, and the items of each."""
        sizes = np.array([len(d) for d in docs], np.int64)
        words = [w for d in docs for w in d]
        h = hasher.array(words)
        hit, found = np.zeros(len(h), bool), [set() for _ in docs]
        ends = np.cumsum(sizes)
        for n, known in self.hashes.items():
            hashes, at = doc_windows(h, sizes, n)
            real = []
            for i in at[contains(known, hashes)].tolist():
                items = self.items.get(b" ".join(words[i : i + n]))
                if items is not None:
                    real.append(i)
                    found[int(np.searchsorted(ends, i, "right"))].update(items)
            if real:
                hit |= cover(np.array(real, np.int64), n, len(h))
        return hit, found


def segments(benchmark: DataFrame, width: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, text): distinct items, those of more words than SEGMENT in parts that have each window of theirs whole."""
    items = benchmark.select(F.col(quoted(item_col)).cast("string").alias("item"), F.col(quoted(text_col)).alias("text")).where("text is not null").distinct()
    is_long = F.length("text") > 2 * SEGMENT  # so that shorter ones, nearly all, are not split
    words = F.filter(F.split("text", f"[{_BETWEEN}]+"), lambda w: w != "")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (width - 1)), F.lit(SEGMENT))
    parts = F.transform(starts, lambda i: F.array_join(F.slice("words", i, SEGMENT + width - 1), " "))
    cut = items.where(is_long).withColumn("words", words).select("item", F.explode(parts).alias("text")).distinct()
    return items.where(~is_long).unionByName(cut)


def _shard_count(benchmark: DataFrame, shard_chars: int) -> int:
    return max(1, math.ceil((benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) / shard_chars))


def _shard(benchmark: DataFrame, k: int, n: int) -> list[tuple[str | None, str | None]]:
    part = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
    return [(r["item"], r["text"]) for r in part.collect()]


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text_col: str = "text", item_col: str = "item_id", share: float = SHARE, shard_chars: int = SHARD_CHARS, cleaned: bool = False) -> DataFrame:
    """docs' columns, and: n_words, n_hit, item_ids (sorted), hit_spans (maximal intervals of word positions), contaminated;
    with ``cleaned`` also clean_text, the text without its hit words and what stands between them."""
    names = ["n_words", "n_hit", "item_ids", "hit_spans", "contaminated", "clean_text"][: 6 if cleaned else 5]
    passed = others(docs, names)
    # columns go by numbers within, so that no name clashes
    out = docs.select(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(passed)], *[F.col(quoted(text_col)).alias("t")] * (text_col not in passed))
    text = f"c{passed.index(text_col)}" if text_col in passed else "t"
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    middle = T.StructType([*out.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("hit_spans", span)])
    spark, items = docs.sparkSession, segments(benchmark, width, item_col)
    n = _shard_count(items, shard_chars)
    for k in range(n):
        index = spark.sparkContext.broadcast(WindowIndex(_shard(items, k, n), width))
        cut = cleaned and k == n - 1
        schema = T.StructType([*middle, T.StructField("clean_text", T.StringType())]) if cut else middle
        scanned = out.mapInArrow(_scanner(index, text, k > 0, cut), schema)
        if k == n - 1:
            out = scanned
            break
        scanned = stored(scanned, "shard")
        index.destroy()
        if k:
            discard(out)
        out = scanned
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    out = out.withColumn("n_hit", n_hit)
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(share) * F.col("n_words")) if share != 0.05 else (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return out.select(*[f"c{k}" for k in range(len(passed))], *names).toDF(*passed, *names)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(text: str | None, spans: list[dict]) -> str | None:
    if not spans:
        return text
    places, out, last = [m.span() for m in _WORD.finditer(text)], [], 0
    for s in spans:
        out.append(text[last : places[s["start"]][0]])
        last = places[s["end"] - 1][1]
    return "".join([*out, text[last:]])


def _scanner(index, text_col: str, later: bool, cut: bool):
    """One pass for one shard: adds its hits to those of earlier shards (``later``); the last one may ``cut`` the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = "hit_spans"
        new, kinds = ["n_words", "item_ids", spans], [pa.int64(), pa.list_(pa.string()), _SPANS]
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 1024):
                b = whole.slice(at, 1024)
                texts = b.column(text_col).to_pylist()
                docs = [words_of(t) for t in texts]
                hit, found = index.value.scan(docs)
                rows, i = [], 0
                old = zip(b.column("item_ids").to_pylist(), b.column(spans).to_pylist()) if later else [((), ())] * len(docs)
                for d, items, (more, before) in zip(docs, found, old):
                    mask = hit[i : i + len(d)].copy()
                    i += len(d)
                    for s in before:
                        mask[s["start"] : s["end"]] = True
                    rows.append((len(d), sorted(items.union(more)), [{"start": a, "end": b} for a, b in intervals(mask)]))
                kept = [n for n in b.schema.names if n not in new]
                arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                names = kept + new
                if cut:
                    arrays.append(pa.array([_cut(t, r[2]) for t, r in zip(texts, rows)], pa.string()))
                    names = names + ["clean_text"]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), *arrays], names)

    return run


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = find_hits(docs, table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return hits.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
bw AS (
  SELECT item_id, least(13, len(w)) AS n, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0
),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM bw),
lengths AS (SELECT DISTINCT n FROM windows),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
hits AS (
  SELECT dw.doc_id, dw.i, dw.n, item_id FROM dw JOIN windows ON dw.n = windows.n AND array_to_string(dw.w[dw.i:dw.i + dw.n - 1], ' ') = windows.t
),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)),
counts AS (SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN counts ON d.doc_id = counts.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
