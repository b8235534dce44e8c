"""SimHash near-duplicates (operator 8): fingerprints, pigeonring candidate filter, components.

``fingerprints``: ``text`` is lower-cased in A-Z, split at ASCII white space into words and into shingles of ``width``
consecutive words (repeats count; a text of fewer words is one shingle; a text without words, or null, has
fingerprint 0 and links like any other). A bit of the fingerprint is 1 if over half of the shingles' XXH64 values (seed
42) have it.

``link_components``: rows whose fingerprints differ in ``most`` bits or fewer are linked; a component's id is its
smallest id. Candidates come from the pigeonring principle: with the 64 bits in a ring of ``zero * most + 1``
segments, two fingerprints within ``most`` bits have a start segment from which, for every chain length l, the first l segments
differ in at most floor(l * most / segments) bits. For the first ``zero`` segments that budget is 0, which is an
equi-join key; longer chains are held against their budgets before the full Hamming distance. ``zero`` is 3 at least, and more for more different fingerprints
(``zero_chain``): keys then have up to 64 / most bits (27 to 31 for most = 2), so that few fingerprints share one by chance.

Equal fingerprints are one node, so exact copies never meet in a join. Fingerprints may still crowd under a key because they are truly near each other (groups of near
copies). Of over ``pair_bucket`` under one key, pairs are not listed: each of them is dealt to its 65 values within one bit, and those that
share such a value are within 2 bits of each other, and the reverse. That is exact and linear, so neither way loses or adds a link (for most <= 2; for larger
``most`` the pairs of a key are joined).

Nulls, ties, repeats: rows with a null id keep a fingerprint, link others like any row and never lend their id; if a whole component has none, its id
is null. A bit that exactly half of the shingles have is 0. Repeated ids are each reported. Very long texts are read whole. Empty tables give empty results. Other columns, whatever they are called, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import components, quoted, stored, table, texts

SEED = 42
#: Least and most segments of a chain that must be equal. More make keys longer, and more of them.
ZERO_CHAIN, LONGEST_ZERO_CHAIN = 3, 15


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes) + np.arange(len(words))
    starts, ends = (ends - sizes)[: 1 - width or None].tolist(), ends[width - 1 :].tolist()
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(ends), 16384):
        s, e = starts[k : k + 16384], ends[k : k + 16384]
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(s, e)), np.uint64, len(e))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.int64)
    on = np.packbits(total * 2 > len(ends), bitorder="little")
    return int(on.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            fps = np.array([fingerprint(t, width) for t in texts(b.column(1).to_pylist())], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text")).mapInArrow(run, "id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def ring_masks(segments: int) -> list[list[int]]:
    """masks[i][l]: the bits of the l segments from segment i on, around the ring; l from 0 to segments."""
    ends = [64 * k // segments for k in range(segments + 1)]
    one = [((1 << ends[k + 1]) - 1) ^ ((1 << ends[k]) - 1) for k in range(segments)]
    return [[sum(one[(i + j) % segments] for j in range(length)) for length in range(segments + 1)] for i in range(segments)]


def _chain_fits(x: Column, start: Column, masks: list[list[int]], most: int) -> Column:
    """Prefix chains from ``start`` stay within their proportional budgets. Only the longest chain of each budget
    needs a look, as shorter ones differ in no more bits."""
    n = len(masks)
    fits = F.lit(True)
    for budget in range(most):
        longest = max(length for length in range(n + 1) if length * most // n == budget)
        of_start = F.element_at(F.array(*[F.lit(_signed(masks[i][longest])) for i in range(n)]), start + 1)
        fits = fits & (F.bit_count(x.bitwiseAND(of_start)) <= budget)
    return fits


def zero_chain(n_fingerprints: int, most: int) -> int:
    """Segments of a chain that must be equal, so that no more than some four fingerprints at random share a key, as far as that goes."""
    for zero in range(ZERO_CHAIN, LONGEST_ZERO_CHAIN):
        if n_fingerprints <= 4 * 2.0 ** (64 * zero / (zero * most + 1)):
            return zero
    return LONGEST_ZERO_CHAIN


def links(nodes: DataFrame, most: int = 2, pair_bucket: int = 16, zero: int = ZERO_CHAIN) -> DataFrame:
    """nodes (fp, node), one row a fingerprint -> edges (u, v) that connect what links of at most ``most`` bits connect."""
    n = zero * most + 1
    masks = ring_masks(n)
    keys = nodes.select(
        "fp", "node", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(masks[i][zero]))) for i in range(n)])).alias("start", "key")
    )
    sizes = keys.groupBy("start", "key").agg(F.count("*").alias("n_in")).where("n_in > 1")
    shared = stored(keys.join(sizes, ["start", "key"]), "ring")
    small = shared.where(F.col("n_in") <= pair_bucket) if most <= 2 else shared
    x = F.col("fp").bitwiseXOR(F.col("fp2"))
    other = small.select("start", "key", F.col("fp").alias("fp2"), F.col("node").alias("node2"))
    pairs = (
        small.join(other, ["start", "key"])
        .where((F.col("fp") < F.col("fp2")) & _chain_fits(x, F.col("start"), masks, most) & (F.bit_count(x) <= most))
        .select(F.col("node").alias("u"), F.col("node2").alias("v"))
    )
    if most > 2:
        return pairs
    crowd = shared.where(F.col("n_in") > pair_bucket).groupBy("fp").agg(F.min("node").alias("node"))
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64 if most == 2 else 0)])
    balls = crowd.select("node", F.explode(near).alias("ball")).groupBy("ball").agg(F.collect_list("node").alias("nodes"))  # 65 at most
    star = balls.where(F.size("nodes") > 1).select(F.array_min("nodes").alias("v"), F.explode("nodes").alias("u"))
    if most == 1:  # the one-bit values themselves, not those half-way between two fingerprints
        flips = F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])
        star = crowd.select("node", F.explode(flips).alias("other")).join(crowd.select(F.col("fp").alias("other"), F.col("node").alias("v")), "other").select("v", F.col("node").alias("u"))
    return pairs.union(star.where("u <> v").select("u", "v"))


#: A fingerprint is hot if it has over one in so many rows; so there are fewer hot ones than that, and those can be broadcast.
HOT_SHARE = 1000


def linked_nodes(prints: DataFrame, most: int = 2, pair_bucket: int = 16) -> tuple[DataFrame, DataFrame]:
    """prints (id, fp) -> nodes (fp, id, n_rows), one row a fingerprint with its smallest id, and roots (fp, root): the smallest
    fingerprint of each one's component. Links are between fingerprints, whether or not their rows have ids."""
    nodes = stored(prints.where("fp is not null").groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n_rows")), "nodes")
    found = components(links(nodes.select("fp", F.col("fp").alias("node")), most, pair_bucket, zero_chain(nodes.count(), most)))
    # only fingerprints in a component of several have a row in found
    return nodes, stored(nodes.select("fp").join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")


def name_components(prints: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """prints (id, fp) -> (id, fp, component_id): the smallest id of the fingerprints with the same root."""
    of = stored(nodes.join(roots, "fp"), "of_root")
    least = stored(of.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    named = of.join(least, "root").select("fp", "component_id", "n_rows")
    # rows of a hot fingerprint (many exact copies) are named where they are, the others by a join
    total = nodes.agg(F.sum("n_rows")).first()[0] or 0
    is_hot = F.col("n_rows") > max(100, total // HOT_SHARE)
    hot = F.broadcast(named.where(is_hot).select("fp", F.struct("component_id").alias("hot")))
    split = prints.join(hot, "fp", "left")
    there = split.where("hot is not null").select("id", "fp", "hot.component_id")
    return split.where("hot is null").select("id", "fp").join(named.where(~is_hot).drop("n_rows"), "fp", "left").select("id", "fp", "component_id").unionByName(there)


def link_components(prints: DataFrame, most: int = 2, pair_bucket: int = 16) -> DataFrame:
    """prints (id, fp) -> (id, fp, component_id). Reads ``prints`` several times: give it a stored table."""
    return name_components(prints, *linked_nodes(prints, most, pair_bucket))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 2) -> DataFrame:
    """(id, fingerprint: 16 hex digits, component_id) for every row of docs."""
    prints = stored(fingerprints(docs, id_col, text_col, width), "prints")
    out = link_components(prints, most)
    return out.select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
