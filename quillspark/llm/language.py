"""Language identification (operator 7): nearest centroid of TF-IDF character n-grams.

A text's letters, in small letters, with one space for whatever lies between them, give n-grams of one to three characters,
hashed into ``dims`` buckets. Weights are (1 + log count) * idf, scaled to length 1. Each language has up to ``centroids``
centroids, found by spherical k-means over its sample. A text gets the language of the centroid with the greatest cosine; where that cosine is
below the ``reject`` quantile of the centroid's own sample, the text is too far away and ``rejected`` is true.

``fit`` learns from about ``sample_rows`` rows, as many for each language as there are languages to share them and at least one for each, however many languages there are; they are chosen by a hash of
id and text, repeated rows once. Features are made on the executors, so the driver holds that many rows of ``dims`` half-precision numbers and no texts. Rows with a null lang
or text teach nothing. Null texts and texts without a letter are ``und`` with score 0; of centroids at the same cosine the one of the first language in alphabetical order wins.
Without a row to learn from, everything is ``und``. Repeated rows are each reported, an empty table gives an empty result, very long texts are read whole. Other columns, whatever they
are called, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import mix, quoted, table, texts

DIMS = 4096
SAMPLE_ROWS = 4000
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngram_counts(batch: list[str], dims: int = DIMS) -> np.ndarray:
    """Counts of hashed n-grams, one row a text; a text without letters has a row of zeros."""
    out = np.zeros((len(batch), dims), np.float32)
    for row, text in zip(out, batch):
        for k in range(0, len(text), 1 << 20):  # n-grams across such a border are not missed by anyone
            c = np.frombuffer(text[k : k + (1 << 20)].lower().encode("utf-32-le", "surrogatepass"), "<u4")
            letter = _is_letter()[c]
            if not letter.any():
                continue
            c = np.where(letter, c, 32).astype(np.uint64)
            keep = letter.copy()
            keep[1:] |= letter[:-1]  # of several signs in a row the first stays, as a space
            c = np.concatenate(([np.uint64(32)], c[keep], [np.uint64(32)]))
            space = c == 32
            two = c[:-1] * np.uint64(0x1F0003) + c[1:]
            three = two[:-1] * np.uint64(0x1F0003) + c[2:]
            middle = ~space[1:-1]
            grams = np.concatenate((c[~space], two[~(space[:-1] & space[1:])] + np.uint64(1 << 50), three[middle] + np.uint64(1 << 51)))
            row += np.bincount((mix(grams) % np.uint64(dims)).astype(np.int64), minlength=dims)
    return out


@dataclass
class LanguageModel:
    idf: np.ndarray
    centres: np.ndarray
    langs: list[str]
    limits: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, batch: list[str]) -> tuple[list[str], list[float], list[bool]]:
        counts = ngram_counts(batch, len(self.idf))
        cosine = self.vectors(counts) @ self.centres.T if len(self.langs) else np.zeros((len(batch), 1))
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(batch)), best], 0, 1)
        some = (counts.sum(axis=1) > 0) & bool(self.langs)
        langs = [self.langs[b] if s else UNKNOWN for b, s in zip(best, some)]
        far = [bool(s and x < self.limits[b]) for b, s, x in zip(best, some, score)]
        return langs, np.where(some, score, 0.0).astype(float).tolist(), far


def _cluster(v: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from the first row and those farthest from what is chosen."""
    chosen = [0]
    while len(chosen) < min(k, len(v)):
        chosen.append(int((v @ v[chosen].T).max(axis=1).argmin()))
    centres = v[chosen]
    for _ in range(rounds):
        of = (v @ centres.T).argmax(axis=1)
        centres = np.stack([v[of == i].sum(axis=0) if (of == i).any() else centres[i] for i in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres, (v @ centres.T).argmax(axis=1)


#: More languages than this are joined by a shuffle.
BROADCAST_LANGS = 100_000


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int) -> tuple[DataFrame | None, int]:
    """((text, lang, place) of the rows to learn from, how many a language has at most): each language's with the smallest place, a hash of id and text."""
    able = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), F.col(quoted(lang_col)).alias("lang")).where("lang is not null and text is not null")
    place = F.xxhash64("id", "text", F.lit(7))
    sizes = able.groupBy("lang").agg(F.approx_count_distinct(place, 0.02).alias("n"))  # rows that differ, however often they are repeated
    n = sizes.count()
    if not n:
        return None, 0
    each = max(1, rows // n)
    # Those below a share of the hash's range, of which hardly any language has too few; only these few are ranked
    share = sizes.select("lang", F.least(F.lit(1.0), F.lit(each + 10.0 * each**0.5 + 20.0) / F.greatest(F.lit(1), "n")).alias("share"))
    near = able.withColumn("place", place).join(F.broadcast(share) if n <= BROADCAST_LANGS else share, "lang")
    near = near.where((F.col("place").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) <= F.col("share")).dropDuplicates(["lang", "place"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    return near.withColumn("rank", rank).where(F.col("rank") <= each).select("text", "lang", "place"), each


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, centroids: int = 4, dims: int = DIMS, reject: float = 0.01) -> LanguageModel:
    picked, _ = sample(docs, id_col, text_col, lang_col, sample_rows)
    if picked is None:
        return LanguageModel(np.zeros(dims), np.zeros((0, dims)), [], np.zeros(0))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                cells = [packed(np.minimum(x, 60000).astype(np.float16).tobytes()) for x in ngram_counts(texts(part.column(0).to_pylist()), dims)]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(cells, pa.binary())], ["lang", "place", "x"])

    unpacked = zstandard.ZstdDecompressor().decompress
    rows = sorted(picked.mapInArrow(features, "lang string, place long, x binary").collect(), key=lambda r: (r["place"], r["lang"]))
    by_lang: dict[str, list[np.ndarray]] = {}
    for r in rows:
        if (x := np.frombuffer(unpacked(r["x"]), np.float16)).any():
            by_lang.setdefault(r["lang"], []).append(x)
    by_lang = dict(sorted(by_lang.items()))
    if not by_lang:
        return LanguageModel(np.zeros(dims), np.zeros((0, dims)), [], np.zeros(0))
    seen = np.stack([x for own in by_lang.values() for x in own]) > 0
    model = LanguageModel(np.log((1 + len(seen)) / (1 + seen.sum(axis=0))).astype(np.float32) + 1, np.zeros((0, dims)), [], np.zeros(0))
    centres, langs, limits = [], [], []
    for lang, own in by_lang.items():
        v = model.vectors(np.stack(own).astype(np.float32))
        found, of = _cluster(v, centroids)
        for i, c in enumerate(found):
            near = (v[of == i] @ c) if (of == i).any() else np.zeros(1)
            centres.append(c)
            langs.append(lang)
            limits.append(float(np.quantile(near, reject)))
    model.centres, model.langs, model.limits = np.stack(centres).astype(np.float32), langs, np.array(limits)
    return model


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # centroids * dims numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                langs, scores, far = shared.value.predict(texts(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    picked = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    return picked.mapInArrow(run, "id long, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs.where(~held_out())))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "rejected")
