"""Near copies by shingles (the pipeline's second stage): documents of a Jaccard similarity of 0.8 or more.

A text's words are those of SimHash (lower-cased in A-Z, split at ASCII white space); its set is that of its runs of ``WIDTH`` = 5
consecutive words (a text of fewer words is one shingle). Two documents are linked if SimHash links them (3 words, 2 bits) or if the
sets' exact Jaccard similarity is at least ``LEAST``; a component's id is its smallest id.

Candidates come from MinHash: ``BANDS`` keys of ``ROWS`` minima each. A pair of similarity s shares no key with probability (1 - s**ROWS)**BANDS,
which is 7e-10 at 0.8 and less above. Candidates of which fewer than ``ALIKE`` of the 160 minima agree (a byte of each is kept) are far from 0.8: a pair at 0.8 has so few with probability
1e-6. Every other candidate pair not yet in one component is checked against the sets, none is dropped for the size of its group.

Large groups of near copies are not listed as pairs. Under each key texts are compared with its *centre*, the one that shares keys with most others; then with another one of the key, drawn by a hash; either time a text is
checked against the one of those that it agrees with most. That joins nearly all of a group. Only texts that are then still outside the key's main component meet all others, in blocks of ``BLOCK`` by ``BLOCK``
texts, within which minima and then sets are compared as arrays; only links become rows, and likely pairs of a text of over ``CARRIED`` shingles, whose sets come by a join.

Nulls, repeats: texts without words link with each other only. Equal texts are one node. Rows with a null id link others and never lend their id. Very long texts are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import BASE, captured, components, contains, delete, discard, hasher, mix, pack, quoted, stored, texts, unpack, window_hashes
from quillspark.llm.simhash import fingerprint, linked_nodes, name_components

WIDTH = 5
LEAST = Fraction(4, 5)
BANDS, ROWS = 40, 4
ALIKE = 104
BLOCK = 4096
CARRIED = 2000
_draw = np.random.default_rng(8)
_XOR = _draw.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_TIMES = _draw.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_OF_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
_CHUNK = 256


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(window_hashes(hasher.array(words), min(width, len(words)))) if words else np.empty(0, np.uint64)


def band_keys(shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
    """BANDS keys and a byte of each minimum; none for an empty set."""
    if not len(shingles):
        return np.empty(0, np.uint64), b""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for k in range(0, len(shingles), _CHUNK):
        np.minimum(least, ((shingles[None, k : k + _CHUNK] ^ _XOR) * _TIMES).min(axis=1), out=least)
    keys = _OF_BAND
    for row in least.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(BASE) + row)
    return keys, (mix(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def alike(a: np.ndarray, b: np.ndarray, least: Fraction = LEAST) -> bool:
    """Whether the sets' Jaccard similarity is at least ``least``."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * least.denominator >= (len(a) + len(b) - both) * least.numerator


#: So many nodes or documents at most are broadcast, eight bytes each; more of them are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """df (stored), to be broadcast if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def marks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, node, keys, minima): SimHash fingerprint, hash of the text, its MinHash keys and a byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            column = texts(b.column(1).to_pylist())
            fps = np.array([fingerprint(t) for t in column], np.uint64)
            found = [band_keys(shingle_set(t)) for t in column]
            keys, minima = pa.array([k.view(np.int64) for k, _ in found], pa.list_(pa.int64())), pa.array([m for _, m in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), b.column(2), keys, minima], ["id", "fp", "node", "keys", "minima"])

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"), F.xxhash64(quoted(text_col)).alias("node"))
    return rows.mapInArrow(run, "id long, fp long, node long, keys array<long>, minima binary")


_PAIR = ["u", "v", "of_u", "of_v"]
_PAIR_KINDS = "u long, v long, of_u long, of_v long"


def _minima(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def _best(of_texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (u, v, of_u, of_v) of nodes and their roots, for each u the one of which most minima agree, if enough do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            agree = (_minima(b.column(4)) == _minima(b.column(5))).sum(axis=1)
            out = pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(agree, pa.int64())], [*_PAIR, "agree"])
            yield out.filter(pa.array(agree >= ALIKE, pa.bool_()))

    mu, mv = (of_texts.select(F.col("node").alias(n), F.col("minima").alias(f"m{n}")) for n in "uv")
    likely = pairs.join(mv, "v").join(mu, "u").select(*_PAIR, "mu", "mv").mapInArrow(run, f"{_PAIR_KINDS}, agree long")
    best = likely.groupBy("u").agg(F.max(F.struct("agree", "v", "of_u", "of_v")).alias("x"))
    return best.select("u", "x.v", "x.of_u", "x.of_v")


def _outside(rows: DataFrame) -> DataFrame:
    """rows (key, node, root, main, n_in, n_out, minima, shingles) -> pairs (u, v, of_u, of_v, sure) of texts outside their key's main component and others of the key: links where
    ``sure``, else pairs to be checked. Shingles may be null."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        mu, mv = _minima(left.column("minima")), _minima(right.column("minima"))
        u, of_u = (left.column(c).to_numpy() for c in ("u", "of_u"))
        v, of_v = (right.column(c).to_numpy() for c in ("node", "root"))
        main = right.column("main")[0].as_py() if len(v) else None
        sets = [None if x is None else unpack(x) for x in right.column("shingles").to_pylist()]
        sizes, known = np.array([0 if x is None else len(x) for x in sets]), np.array([x is not None for x in sets], bool)
        out = []
        for k, packed in enumerate(left.column("shingles").to_pylist()):
            at = np.flatnonzero((of_v != of_u[k]) & ((of_v == main) | (u[k] < v))) if len(v) else np.empty(0, np.int64)
            at = at[(mv[at] == mu[k]).sum(axis=1) >= ALIKE]
            unsure = at if packed is None else at[~known[at]]
            out += [(u[k], v[i], of_u[k], of_v[i], False) for i in unsure.tolist()]
            if packed is None or not known[at].any():
                continue
            at, own = at[known[at]], unpack(packed)
            theirs = np.concatenate([sets[i] for i in at.tolist()])
            hit = contains(own, theirs)
            both = np.add.reduceat(hit, np.concatenate(([0], np.cumsum(sizes[at])[:-1])), dtype=np.int64)
            linked = at[both * LEAST.denominator >= (len(own) + sizes[at] - both) * LEAST.numerator]
            _, first = np.unique(of_v[linked], return_index=True)  # a link to each component is enough
            out += [(u[k], v[i], of_u[k], of_v[i], True) for i in linked[first].tolist()]
        columns = list(zip(*out)) or [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.bool_())], names=[*_PAIR, "sure"])

    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    rows = rows.withColumns({"bu": (own % blocks("n_out")).cast("int"), "bv": (own % blocks("n_in")).cast("int")})
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    own = [F.col(c).alias(n) for c, n in (("key", "of_key"), ("node", "u"), ("root", "of_u"), ("minima", "minima"), ("shingles", "shingles"), ("bu", "row"))]
    left = rows.where("root <> main").select(*own, every("n_in").alias("column"))
    right = rows.select("key", "node", "root", "main", F.col("minima").alias("minima"), F.col("shingles").alias("shingles"), "bv", every("n_out").alias("bu"))
    return left.groupBy("of_key", "row", "column").cogroup(right.groupBy("key", "bu", "bv")).applyInArrow(compare, f"{_PAIR_KINDS}, sure boolean")


def _sets(docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """(node, n, shingles) of the texts with these hashes, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            made = [shingle_set(t) for t in texts(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in made], pa.int64()), pa.array([pack(x) for x in made], pa.binary())], ["node", "n", "shingles"])

    asked = stored(nodes.distinct(), "asked")
    rows = docs.select(F.xxhash64(quoted(text_col)).alias("node"), F.col(quoted(text_col)).alias("text")).join(few(asked), "node", "left_semi")
    out = stored(rows.dropDuplicates(["node"]).mapInArrow(run, "node long, n long, shingles binary"), "sets")
    discard(asked)
    return out


def _checked(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (u, v, of_u, of_v) of nodes and their roots -> (u, v): roots of those whose texts are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            fits = [alike(unpack(x), unpack(y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(fits, pa.bool_()))

    su, sv = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"s{n}")) for n in "uv")
    return pairs.join(sv, "v").join(su, "u").select("of_u", "of_v", "su", "sv").mapInArrow(run, "u long, v long")


def _joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    found = components(edges).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return stored(roots.join(few(found), "root", "left").select("fp", F.coalesce("to", "root").alias("root")), "roots")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) for every row of docs, stored; all that led to it is deleted."""
    with captured() as made:
        out = stored(_near_copies(docs, id_col, text_col), "copies")
    for folder in made[:-1]:
        delete(docs.sparkSession, folder)
    return out


def _near_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    marked = stored(marks(docs, id_col, text_col), "marks")
    prints = marked.select("id", "fp")
    nodes, roots = linked_nodes(prints)
    of_texts = stored(marked.select("node", "fp", "keys", "minima").dropDuplicates(["node"]), "of_texts")
    # one exchange by key: the keys that several texts have, and then those texts
    keys = of_texts.select("node", "fp", F.explode("keys").alias("key")).repartition("key")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n_in")).where("n_in > 1")
    shared = stored(keys.join(sizes, "key"), "shared")
    shared = stored(shared.join(shared.groupBy("node").agg(F.sum("n_in").alias("company")), "node"), "shared")
    for turn in ("centre", "another", "outside"):
        labelled = stored(shared.join(roots, "fp").select("key", "node", "root", "company", "n_in"), "labelled")
        place = F.struct("company", "node") if turn == "centre" else F.struct(F.xxhash64("node", "key"), "node")
        state = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max_by(F.struct("node", "root"), place).alias("centre"), F.mode("root").alias("main"))
        state = stored(state.where("lo <> hi").select("key", "centre", "main"), "open")
        rows = labelled.join(few(state), "key")
        if turn == "outside":
            n_out = rows.where("root <> main").groupBy("key").agg(F.count("*").alias("n_out"))
            sets = _sets(docs, rows.select("node"), text_col)
            carried = F.when(F.col("n") <= CARRIED, F.col("shingles")).alias("shingles")
            seen = rows.join(n_out, "key").join(of_texts.select("node", "minima"), "node").join(sets.select("node", carried), "node")
            found = stored(_outside(seen).distinct(), "pairs")
            links = found.where("sure").select(F.col("of_u").alias("u"), F.col("of_v").alias("v")).unionByName(_checked(sets, found.where("not sure")))
        else:
            apart = rows.where("root <> centre.root")
            found = apart.select(F.col("node").alias("u"), F.col("centre.node").alias("v"), F.col("root").alias("of_u"), F.col("centre.root").alias("of_v")).distinct()
            found = stored(_best(of_texts, found), "pairs")
            sets = _sets(docs, found.select(F.explode(F.array("u", "v")).alias("node")), text_col)
            links = _checked(sets, found)
        links = stored(links.distinct(), "links")
        for used in (labelled, state, found, sets):
            discard(used)
        if not links.isEmpty():
            roots = _joined(roots, links)
    return name_components(prints, nodes, roots).select("id", "component_id")
