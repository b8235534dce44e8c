"""Quality classifier (operator 2): co-training of a text view and a metadata view.

The text view has hashed words, hashed word shapes and how often words repeat. The metadata view has what is known of a page besides its words: source, language, the
given length, and its layout (lines and their lengths, repeated lines, shares of capitals, digits, marks, markup signs and blanks). Each is a logistic
regression. In each of ``rounds`` both are calibrated on labelled documents kept apart; each then labels the unlabelled documents of which it is sure
(a calibrated probability of ``sure`` or more for either class), and hands up to ``hand_over`` of them, in the classes' proportion and by a hash of their content, to the *other* view's training set.
At the end a two-input logistic regression over the calibrated views, without a view that it would give a negative weight, makes ``score``, the probability of
good quality. ``keep``: the score reaches the threshold between ``LEAST`` and 0.5 at which, on a second part of the labelled documents kept apart, lost good documents
(``cost`` each) and kept bad ones (1 each) cost least.

``features`` writes every document's features once, a few hundred bytes each, to the shared folder; all passes, over all documents, read those. ``fit`` learns from at most ``sample_rows`` labelled documents
(one text an id), chosen by a hash of the id, and from ``hand_over`` documents a view and round; the pool that these come from is all of the documents.

Null or empty texts have zeros for features and are scored like any other; null metadata are a value of their own. Equal texts with equal metadata score alike. Several labels of one
document: their mean counts, from 0.5 on as good. Without labels of both classes in each part there is nothing to learn: score 1.0, all kept. Very long texts are read whole. Further columns pass
through, but for those that are called, in any case, like an output. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import LONG_WORD, discard, others, quoted, stored, table, texts, use

SAMPLE_ROWS = 6000
HAND_OVER = 400
SHAPES = WORDS = 512
RATIOS = 3
TEXT_DIMS = RATIOS + SHAPES + WORDS
SOURCES, LANGS, LAYOUT = 64, 16, 12
META_DIMS = LAYOUT + SOURCES + LANGS + 3
#: Least threshold of ``keep``, however the documents kept apart are scored.
LEAST = 0.02
OUT = ["text_score", "meta_score", "score", "keep"]
_RUNS = [(re.compile(r"[^\W\d_]+"), lambda m: "A" if m.group().isupper() else "Aa" if m.group()[0].isupper() else "a"), (re.compile(r"\d+"), lambda m: "0"), (re.compile(r"(.)\1+"), lambda m: m.group(1) * 2)]


class _Codes(dict):
    """word -> shape bucket + SHAPES * word bucket; bounded like WordHasher."""

    def __missing__(self, word: str) -> int:
        shape = word
        for pattern, by in _RUNS:
            shape = pattern.sub(by, shape)
        letters = "".join(c for c in word.lower() if c.isalnum())
        code = xxhash.xxh64_intdigest(shape) % SHAPES + SHAPES * (xxhash.xxh64_intdigest(letters) % WORDS)
        if len(word) <= LONG_WORD:
            if len(self) >= 150_000:
                self.clear()
            self[word] = code
        return code


_codes = _Codes()


def _bytes(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1 as bytes."""
    return np.round(np.clip(x, 0, 1) * 255).astype(np.uint8)


def text_features(batch: list[str]) -> np.ndarray:
    """A byte a feature, 255 for 1."""
    out = np.zeros((len(batch), TEXT_DIMS), np.uint8)
    for x, text in zip(out, batch):
        words = text.split()
        n = len(words)
        if not n:
            continue
        codes = np.fromiter(map(use(_codes).__getitem__, words), np.int64, n)
        word, shape = np.divmod(codes, SHAPES)
        x[:RATIOS] = _bytes(np.array([len(set(words)) / n, np.mean(codes[1:] == codes[:-1]) if n > 1 else 0, np.log1p(n) / 20]))
        x[RATIOS : RATIOS + SHAPES] = _bytes(np.sqrt(np.bincount(shape, minlength=SHAPES) / n))
        x[RATIOS + SHAPES :] = _bytes(np.sqrt(np.bincount(word, minlength=WORDS) / n))
    return out


_CAPITALS, _DIGITS, _MARKS, _MARKUP, _BLANKS = (bytes(c for c in range(128) if f(chr(c))) for f in (str.isupper, str.isdigit, ".,;:!?'\"-()".__contains__, "|<>{}[]#*&%$=_~^@/\\+".__contains__, str.isspace))


def layout(text: str) -> np.ndarray:
    """LAYOUT numbers from 0 to 1 on how a page looks, whatever its words are."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    lines = [s for s in raw.split(b"\n") if s.strip()]
    share = [(len(raw) - len(raw.translate(None, signs))) / n for signs in (_CAPITALS, _DIGITS, _MARKS, _MARKUP, _BLANKS)]
    sizes = np.array([len(s) for s in lines] or [0])
    ends = sum(s.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for s in lines) / max(1, len(lines))
    one = [np.log1p(len(lines)) / 15, np.log1p(sizes.mean()) / 15, np.log1p(sizes.std()) / 15, len(set(lines)) / max(1, len(lines)), ends]
    most = max((raw.count(bytes([c])) for c in _MARKUP), default=0) / n
    return np.array([*np.sqrt(share), *one, np.sqrt(most), len(raw) > 0])


def meta_features(batch: list[str], sources: list, langs: list, lengths: list) -> np.ndarray:
    """A byte a feature, 255 for 1."""
    out = np.zeros((len(batch), META_DIMS), np.uint8)
    for x, text, s, lang, n in zip(out, batch, sources, langs, lengths):
        x[:LAYOUT] = _bytes(layout(text))
        x[LAYOUT + xxhash.xxh64_intdigest(str(s)) % SOURCES] = 255
        x[LAYOUT + SOURCES + xxhash.xxh64_intdigest(str(lang)) % LANGS] = 255
        size = np.log1p(max(0, n or 0)) / 20
        x[-3:] = _bytes(np.array([size, 4 * size * size, n is None]))
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 250, rate: float = 0.1, alike: bool = True) -> np.ndarray:
    """Weights of a logistic regression, whose classes weigh ``alike`` or as they are, by Adam; the last is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    weight = np.where(y > 0.5, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean())) if alike else np.ones(len(y))
    weight = weight.astype(np.float32) / len(y)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        g = x.T @ (weight * (_sigmoid(x @ w) - y).astype(np.float32)) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _logits(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _calibrated(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(scale, shift) that make logits those of probabilities; a view that ranks no better than chance says the same of every document."""
    scale, shift = logistic(logits[:, None], y, 1e-4, 500, 0.05, alike=False)
    if scale <= 0:
        good = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        return 0.0, float(np.log(good / (1 - good)))
    return float(scale), float(shift)


@dataclass
class QualityModel:
    #: for each view: its weights, and scale and shift of its logit; no views: nothing learned
    views: list[tuple[np.ndarray, float, float]] = field(default_factory=list)
    #: logit of the score = a * calibrated text logit + b * calibrated metadata logit + c
    joint: np.ndarray = field(default_factory=lambda: np.zeros(3))
    threshold: float = 0.5
    #: what was handed over in each round, by view and class, and each view's AUC on documents kept apart
    report: list[dict] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> list[np.ndarray]:
        """x: bytes of both views."""
        parts = x[:, :TEXT_DIMS], x[:, TEXT_DIMS:]
        return [scale * _logits(w, p.astype(np.float32) / 255) + shift for (w, scale, shift), p in zip(self.views, parts)]

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.views:
            return (np.ones(len(x)),) * 3
        a, b = self.logits(x)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.joint[0] * a + self.joint[1] * b + self.joint[2])


def auc(scores: np.ndarray, y: np.ndarray) -> float:
    """How often a good document scores above a bad one; ties half."""
    good, bad = scores[y > 0.5], np.sort(scores[y <= 0.5])
    return float((np.searchsorted(bad, good, "left") + np.searchsorted(bad, good, "right")).mean() / 2 / max(1, len(bad)))


class Pool(Protocol):
    """The unlabelled documents."""

    def sure_of(self, model: QualityModel, sure: float, most: tuple[int, int], used: set[int]) -> dict[tuple[int, int], list[int]]:
        """For each view and class (0, 1): of the documents that it is sure of, but those used, the ``most[class]`` with the least distinct content hashes."""

    def rows(self, hashes: set[int]) -> dict[int, np.ndarray]:
        """The features of documents with these content hashes."""


def co_train(x: np.ndarray, y: np.ndarray, known: set[int], pool: Pool, rounds: int, hand_over: int, sure: float, cost: float) -> QualityModel:
    """x: bytes of labelled documents, in random order; y: their classes; known: their content hashes, which the pool may hold, too."""
    of = np.arange(len(y)) % 5
    train, apart, last = of < 3, of == 3, of == 4
    if any(len(set(y[s])) < 2 for s in (train, apart, last)):
        return QualityModel()
    cut = [slice(None, TEXT_DIMS), slice(TEXT_DIMS, None)]
    sets = [(x[train][:, c], y[train]) for c in cut]
    bad = max(1, round(hand_over * (1 - y[train].mean())))
    used, model = set(known), QualityModel()
    for k in range(rounds + 1):
        model.views = []
        for c, (own, labels) in zip(cut, sets):
            w = logistic(own.astype(np.float32) / 255, labels)
            model.views.append((w, *_calibrated(_logits(w, x[apart][:, c].astype(np.float32) / 255), y[apart])))
        seen = {"auc": [round(auc(z, y[last]), 4) for z in model.logits(x[last])]}
        model.report.append(seen)
        if k == rounds:
            break
        found = pool.sure_of(model, sure, (bad, max(1, hand_over - bad)), used)
        seen["handed"] = {key: len(h) for key, h in sorted(found.items())}
        new = set().union(*found.values())
        if not new:
            break
        rows = pool.rows(new)
        for view in (0, 1):
            for label in (0, 1):
                hashes = found.get((view, label), [])
                if hashes:
                    own, labels = sets[1 - view]
                    more = np.stack([rows[h] for h in hashes])[:, cut[1 - view]]
                    sets[1 - view] = np.vstack([own, more]), np.concatenate((labels, np.full(len(hashes), float(label))))
        used |= new
    both = np.stack(model.logits(x[apart]), axis=1)
    use_of = [0, 1]
    while True:
        w = logistic(both[:, use_of], y[apart], 1e-4, 500, 0.05, alike=False)
        if len(use_of) == 1 or (w[:-1] >= 0).all():
            break
        use_of.pop(int(w[:-1].argmin()))
    model.joint = np.zeros(3)
    model.joint[use_of], model.joint[2] = np.maximum(w[:-1], 0), w[-1]
    scores = model.score(x[last])[2]
    model.report[-1] |= {"joint": round(auc(scores, y[last]), 4)}
    model.threshold = _threshold(scores, y[last], cost)
    return model


def _threshold(scores: np.ndarray, y: np.ndarray, cost: float) -> float:
    """Half-way between two scores (or at an end of the range allowed), where the documents below and above it cost least; of several the least."""
    steps = np.unique(np.clip(scores, LEAST, 0.5))
    tried = np.unique(np.concatenate(([LEAST, 0.5], (steps[1:] + steps[:-1]) / 2)))
    costs = [cost * np.sum((scores < t) & (y > 0.5)) + np.sum((scores >= t) & (y <= 0.5)) for t in tried]
    return float(tried[int(np.argmin(costs))])


def _rows(blobs: list[bytes]) -> np.ndarray:
    unpacked = zstandard.ZstdDecompressor().decompress
    return np.frombuffer(b"".join(map(unpacked, blobs)), np.uint8).reshape(-1, TEXT_DIMS + META_DIMS)


#: Rows that features and scores are made for at once.
_ROWS = 1024


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars", passed: list[str] | None = None) -> DataFrame:
    """(c0, c1, ...: the columns in ``passed``, id, h: hash of the content, x: packed features) of every row, stored in the shared folder. Only what features are made of goes to Python."""

    def run(text: pa.Array, source: pa.Array, lang: pa.Array, n: pa.Array) -> pa.Array:
        packed, hashes, rows = zstandard.ZstdCompressor(level=3).compress, [], []
        for i in range(0, len(text), _ROWS):
            t, *meta = (c.slice(i, _ROWS).to_pylist() for c in (text, source, lang, n))
            t = texts(t)
            both = np.hstack([text_features(t), meta_features(t, *meta)])
            hashes += [xxhash.xxh64_intdigest(x.tobytes()) for x in both]
            rows += [packed(x.tobytes()) for x in both]
        h = pa.array(np.array(hashes, np.uint64).view(np.int64), pa.int64())
        return pa.StructArray.from_arrays([h, pa.array(rows, pa.binary())], ["h", "x"])

    made = F.arrow_udf(run, "h long, x binary")
    own = [F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(passed or [])]
    inputs = [F.col(quoted(c)) for c in (text_col, source_col, lang_col)] + [F.col(quoted(size_col)).cast("long")]
    out = docs.select(*own, F.col(quoted(id_col)).alias("id"), made(*inputs).alias("f"))
    return stored(out.select(*[f"c{k}" for k in range(len(own))], "id", "f.h", "f.x"), "features")


class SparkPool:
    """All documents of a table of features."""

    def __init__(self, made: DataFrame):
        self.made = made

    def sure_of(self, model: QualityModel, sure: float, most: tuple[int, int], used: set[int]) -> dict[tuple[int, int], list[int]]:
        shared = self.made.sparkSession.sparkContext.broadcast((model.views, np.array(sorted(used), np.int64)))
        limit = float(np.log(sure / (1 - sure)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            views, known = shared.value
            model, best = QualityModel(views), {(v, c): np.empty(0, np.int64) for v in (0, 1) for c in (0, 1)}
            for b in (whole.slice(i, _ROWS) for whole in batches for i in range(0, whole.num_rows, _ROWS)):
                h = b.column(0).to_numpy(zero_copy_only=False)
                fresh = ~np.isin(h, known)
                for v, z in enumerate(model.logits(_rows(b.column(1).to_pylist()))):
                    for c, sure_of in ((0, z <= -limit), (1, z >= limit)):
                        best[v, c] = np.unique(np.concatenate((best[v, c], h[fresh & sure_of])))[: most[c]]
            rows = [(v, c, x) for (v, c), hs in best.items() for x in hs.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], ["view", "label", "h"])

        found = stored(self.made.select("h", "x").mapInArrow(run, "view int, label int, h long").distinct(), "sure")
        out = {(v, c): [r[0] for r in found.where((F.col("view") == v) & (F.col("label") == c)).select("h").orderBy("h").limit(most[c]).collect()] for v in (0, 1) for c in (0, 1)}
        discard(found)
        shared.unpersist()
        return out

    def rows(self, hashes: set[int]) -> dict[int, np.ndarray]:
        asked = F.broadcast(self.made.sparkSession.createDataFrame([(h,) for h in hashes], "h long"))  # 2 * hand_over at most
        got = self.made.select("h", "x").join(asked, "h").groupBy("h").agg(F.min("x").alias("x")).collect()
        return {r["h"]: _rows([r["x"]])[0] for r in got}


def fit(made: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, rounds: int = 3, hand_over: int = HAND_OVER, sure: float = 0.9, cost: float = 10.0) -> QualityModel:
    """made: what features() returns; labels (id, 0 or 1)."""
    known = labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(sample_rows))
    one = F.min(F.struct("h", "x")).alias("r")
    got = made.select("id", "h", "x").join(chosen, "id").groupBy("id", "y").agg(one).select("id", "y", "r.h", "r.x").collect()
    if not got:
        return QualityModel()
    got.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["id"])), r["h"]))
    x, y = _rows([r["x"] for r in got]), np.array([r["y"] for r in got])
    return co_train(x, y, {r["h"] for r in got}, SparkPool(made), rounds, hand_over, sure, cost)


def judge(made: DataFrame, model: QualityModel) -> DataFrame:
    """made without its features, and text_score, meta_score, score, keep."""
    shared = made.sparkSession.sparkContext.broadcast(model)  # some thousand numbers

    def run(x: pa.Array) -> pa.Array:
        parts = [shared.value.score(_rows(x.slice(i, _ROWS).to_pylist())) for i in range(0, len(x), _ROWS)]
        text, meta, score = (np.concatenate([p[k] for p in parts] or [np.empty(0)]).astype(float) for k in range(3))
        return pa.StructArray.from_arrays([pa.array(text), pa.array(meta), pa.array(score), pa.array(score >= shared.value.threshold, pa.bool_())], OUT)

    judged = F.arrow_udf(run, "text_score double, meta_score double, score double, keep boolean")
    kept = [c for c in made.columns if c not in ("h", "x")]
    return made.select(*kept, judged("x").alias("judged")).select(*kept, "judged.*")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars", **options) -> DataFrame:
    """docs' columns, and text_score, meta_score, score, keep. options: those of fit()."""
    passed = others(docs, OUT)
    made = features(docs, id_col, text_col, source_col, lang_col, size_col, passed)
    out = judge(made, fit(made, labels, **options))
    return out.select(*[F.col(f"c{k}") for k in range(len(passed))], *OUT).toDF(*passed, *OUT)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    made = features(docs)
    return judge(made, fit(made, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
