"""Each operator against a brute-force version on small tables with nulls, empty, very long and repeated texts."""

import hashlib
import itertools
import json
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from quillspark.llm import common, decontaminate, fingerprint, language, matrices, near_copies, packing, quality, scoring, simhash, substring, tokens, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block int, hits string, id long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, n=60):
    """Rows with copies, near copies, shared passages, nulls, empty, odd and very long texts; extra columns with clashing names."""
    rng = random.Random(seed)
    passage = words(rng, 40)
    rows = []
    for i in range(n):
        kind = i % 12
        text = words(rng, rng.randrange(1, 120))
        if kind == 1:
            text = rows[-1][1]
        elif kind == 2:
            text = words(rng, 30) + "\n" + passage + "  " + words(rng, 10)
        elif kind == 3:
            text = None if i % 24 == 3 else ""
        elif kind == 4:
            text = " \t\n\u00a0" if i % 24 == 4 else "É" * 3 + " naïve 漢字 🙂\x0b\u3000x"
        elif kind == 5 and i < 12:
            text = words(rng, 6000)
        elif kind == 6:
            text = passage + " " + passage
        rows.append((i * 3, text, "en" if i % 3 else None, f"s{i % 5}", None if i % 7 == 0 else len(text or ""), 1, "x", i))
    return rows


CLASHES = ["Text_", "n_words", "KEPT_text", "Hit_Spans", "score", "Keep", "quill_block", "block", "key", "z", "id", "c0"]


def clashing(spark, rows):
    """(doc_id, text) and columns called like outputs and inner columns, each with a value of its own."""
    kinds = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(i, t, *[f"{c}{i}" for c in CLASHES]) for i, t in rows], kinds)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# common


def test_window_hashes_equal_for_equal_windows_only():
    h = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    got = common.window_hashes(h, 3)
    assert got[0] == got[3] and len(set(got.tolist())) == 4
    assert len(common.window_hashes(h, 8)) == 0


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 1000):
        x = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (common.unpack(common.pack(x)) == x).all()
        c = rng.integers(0, 1 << 31, n)
        assert (common.unpack_counts(common.pack_counts(c)) == c).all()


def test_blocks_follow_ids_and_stay_small(spark):
    """Clustered, repeated, missing and far-off ids: blocks rise with the id, and none has many rows."""
    rng = random.Random(3)
    ids = [(p << 33) + n for p in range(200) for n in range(100)] + [7] * 15000 + [None] * 5000 + [-(1 << 63), (1 << 63) - 1]
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(7)
    for blocks, leaves in ((100, 4096), (400, 64)):
        column, most = common.block_column(df, "doc_id", "text", blocks, leaves)
        got = df.select("doc_id", column.alias("b")).collect()
        sizes = Counter(r.b for r in got)
        assert min(sizes) >= 0 and max(sizes) < most
        assert max(sizes.values()) <= (3 if blocks == 100 else 12) * len(ids) / blocks
        spans = {}
        for r in got:
            if r.doc_id is not None:
                lo, hi = spans.get(r.b, (r.doc_id, r.doc_id))
                spans[r.b] = min(lo, r.doc_id), max(hi, r.doc_id)
        order = [spans[b] for b in sorted(spans)]
        assert all(a[1] <= b[0] for a, b in zip(order, order[1:]))
    column, n = common.hash_blocks(df, "doc_id", "text", 50)
    assert max(Counter(r.b for r in df.select(column.alias("b")).collect()).values()) <= 2 * len(ids) / n
    with pytest.raises(TypeError):
        common.block_column(df.selectExpr("cast(doc_id as string) doc_id", "text"), "doc_id", "text")


def test_cells_grow_with_blocks_not_with_their_square(spark):
    """With 4 times the blocks there are about 4 times the cells; at once there would be 16 times as many."""
    df = spark.createDataFrame([(i, words(random.Random(i), 200, 10**6)) for i in range(512)], "doc_id long, text string")

    def cells(n):
        ranges = common.Ranges(n, 8)
        dealt = scoring._packed(df, "doc_id", "text", common.hash_blocks(df, "doc_id", "text", n)[0])
        counted = scoring.count_cells(dealt, 2, ranges)
        return counted.count(), scoring.ngram_totals(counted, ranges).count()

    few, many = cells(16), cells(64)
    assert few[0] == few[1] <= 16 * 8 and many[0] == many[1] <= 64 * 8
    assert many[0] <= 4.5 * few[0]


def test_ranges_nest():
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 5000, np.uint64))
    assert (common.ranges_of(h, 7 * 5) // 5 == common.ranges_of(h, 7)).all()
    assert [(i, j) for _, i, j in common.cuts(h, 9)][-1][1] == 5000 and common.cuts(h[:0], 9) == []


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 180)] + [(5, 5), (7, 9), (9, 7)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 8 SimHash


def brute_fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for text in [None, "", "A", "a b", "a b c", "a b C d e f", "x " * 50, words(random.Random(0), 300)]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def brute_links(prints, most):
    label = {i: i for i, _ in prints}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for (i, a), (j, b) in itertools.combinations(prints, 2):
        if bin(a ^ b).count("1") <= most:
            p, q = sorted((find(i), find(j)))
            label[q] = p
    return {i: find(i) for i, _ in prints}


@pytest.mark.parametrize("most", [1, 2, 3])
def test_links_and_crowded_buckets(spark, most):
    rng = random.Random(most)
    prints = []
    for centre in (rng.getrandbits(64), rng.getrandbits(64)):
        prints += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for _ in range(70)]
    prints += [rng.getrandbits(64) for _ in range(60)] + [0, 0, 3]
    rows = list(enumerate(prints))
    df = spark.createDataFrame([(i, common.np.uint64(p).astype(np.int64).item()) for i, p in rows], "id long, fp long")
    want = brute_links(rows, most)
    for bucket in (2, 1000):
        assert {r.id: r.component_id for r in simhash.link_components(df, most, bucket).collect()} == want


@pytest.mark.parametrize("zero", [3, 5, 15])
def test_links_with_longer_keys(spark, zero):
    """Keys of more segments link the same fingerprints; they grow with the number of fingerprints."""
    rng = random.Random(zero)
    prints = [rng.getrandbits(64) for _ in range(40)]
    prints += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in prints] + [f ^ 7 for f in prints[:20]]
    prints = sorted(set(prints))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(prints)], "fp long, node long")
    got = {tuple(sorted((r.u, r.v))) for r in simhash.links(nodes, 2, 10**6, zero).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2}
    assert [simhash.zero_chain(n, 2) for n in (10**3, 10**9, 10**14)] == [3, 4, 15]


def test_near_duplicates(spark, docs):
    got = {r.id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs.drop("id"), "doc_id").collect()}
    prints = [(r[0], brute_fingerprint(r[1])) for r in corpus()]
    groups = brute_links(prints, 2)
    assert got == {i: (f"{p:016x}", groups[i]) for i, p in prints}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (2, "a b c d"), (None, "only here now")], "doc_id long, text string")
    assert sorted((r.id or -1, r.component_id or -1) for r in simhash.near_duplicates(df).collect()) == [(-1, -1), (-1, 2), (2, 2), (4, 2)]


def test_a_row_without_an_id_links_others(spark):
    df = spark.createDataFrame([(3, 0b1111), (None, 0b0011), (1, 0), (None, 1 << 40), (None, 0b1111 << 50)], "id long, fp long")
    got = {r.fp: r.component_id for r in simhash.link_components(df).collect()}
    assert got == {0b1111: 1, 0b0011: 1, 0: 1, 1 << 40: 1, 0b1111 << 50: None}


# near copies of the pipeline


def brute_copies(rows):
    """id -> smallest id of its component: SimHash within 2 bits, or Jaccard of lower-cased 5-word shingles of 0.8 or more."""
    label = {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    marks = [(i, brute_fingerprint(t), shingles((t or "").encode().lower().decode())) for i, t in rows]
    for (i, f, a), (j, g, b) in itertools.combinations(marks, 2):
        if bin(f ^ g).count("1") <= 2 or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
            p, q = sorted((find(i), find(j)))
            label[q] = p
    return {i: find(i) for i, _ in rows}


def edited(rng, text, k):
    w = text.split()
    for at in rng.sample(range(len(w)), k):
        w[at] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_copies(spark):
    """Copies from just above to just below 0.8, a chain over copies, and a group with many under one key."""
    rng, rows = random.Random(5), []
    for k in range(1, 9):
        base = words(rng, 200, 5000)
        rows += [base, edited(rng, base, k), edited(rng, base, k).upper()]
    step = words(rng, 200, 5000)
    for _ in range(6):
        rows.append(step)
        step = edited(rng, step, 3)
    base = words(rng, 150, 5000)
    rows += [edited(rng, base, rng.randrange(1, 5)) for _ in range(40)] + [None, "", "a b", "A  b", "a b c"]
    rows = [(7 * i + 3, t) for i, t in enumerate(rows)]
    rng.shuffle(rows)
    got = {r.id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = brute_copies(rows)
    assert got == want
    thin = brute_links([(i, brute_fingerprint(t)) for i, t in rows], 2)
    assert sum(want[i] != i for i in want) > sum(thin[i] != i for i in thin)
    assert near_copies.near_copies(empty(spark)).count() == 0


@pytest.mark.parametrize("carried", [2000, 0])
def test_near_copies_of_a_scattered_group(spark, monkeypatch, carried):
    """Many copies of one text around 0.8 from each other: all links are found, in small blocks too, and few of the pairs become rows."""
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    monkeypatch.setattr(near_copies, "CARRIED", carried)
    rng = random.Random(31)
    base = words(rng, 150, 5000)
    rows = [(k, edited(rng, base, rng.randrange(1, 9))) for k in range(120)]
    got = {r.id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_copies(rows) and len(set(got.values())) > 1


def test_pipeline_stage_drops_a_near_copy_of_080(spark):
    import corpus_pipeline

    base = words(random.Random(6), 184, 9000).split()  # 180 shingles; 20 others make 160 / 200
    copy = [*base[:164], *(f"n{i}" for i in range(20))]
    assert 5 * len(shingles(" ".join(base)) & shingles(" ".join(copy))) == 4 * len(shingles(" ".join(base)) | shingles(" ".join(copy)))
    below = [*base[:163], *(f"m{i}" for i in range(21))]
    assert bin(brute_fingerprint(" ".join(base)) ^ brute_fingerprint(" ".join(copy))).count("1") > 2
    rows = [(1, " ".join(base)), (2, " ".join(copy)), (3, words(random.Random(7), 200)), (4, " ".join(below)), (None, " ".join(copy))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect()) == [0, 1, 3, 4]


# 5 substring


def brute_substring(rows, width=20):
    seen, out = set(), {}
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: r[0]):
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - width + 1):
            key = b" ".join(w[i : i + width])
            if key in seen:
                gone |= set(range(i, i + width))
            seen.add(key)
        out[doc] = (len(w), gone, b" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("blocks, fan_out", [(1, 8), (4, 8), (50, 64), (50, 4)])
def test_substring(docs, blocks, fan_out):
    got = {r.doc_id: r for r in substring.dedup_substrings(docs, blocks=blocks, fan_out=fan_out).collect()}
    want = brute_substring(corpus())
    assert got.keys() == want.keys()
    for doc, text in ((r[0], r[1]) for r in corpus()):
        n, gone, kept = want[doc]
        r = got[doc]
        assert (r.n_words, r.n_removed, r.kept_words) == (n, len(gone), kept.decode())
        assert {i for s in r.removed_spans for i in range(s.start, s.end)} == gone
        assert (r.kept_text or "").encode().split() == kept.split()
        assert r.text == text and r.hits == "x" and r.block == 1
        if not gone:
            assert r.kept_text == text


def test_substring_edges(spark):
    assert substring.dedup_substrings(empty(spark)).count() == 0
    text = " ".join(f"t{i}" for i in range(25))
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, text), (None, text), (big, text), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in substring.dedup_substrings(df).collect())
    assert got == [(str(big), 0), (str(big), 25), ("None", 0), ("None", 25)]


def test_substring_clashing_columns_and_hot_id(spark):
    text = words(random.Random(1), 30, 10**6)
    rows = [(1, text), (2, "a " + text), (3, None)]
    df = clashing(spark, rows)
    out = substring.dedup_substrings(df)
    taken = {"n_words", "kept_text"}
    assert [c for c in out.columns if c.lower() not in taken] == [c for c in df.columns if c.lower() not in taken] + ["n_removed", "kept_words", "removed_spans"]
    got = {r.doc_id: r for r in out.collect()}
    assert (got[2].n_removed, got[2].kept_words, got[2].text, got[2].z, got[2].c0) == (30, "a", rows[1][1], "z2", "c02")
    same = spark.createDataFrame([(5, text)] * 40 + [(5, f"x{i} " + text) for i in range(40)], "doc_id long, text string").repartition(4)
    hot = substring.dedup_substrings(same, blocks=16).collect()
    assert len(hot) == 80 and sorted(r.n_removed for r in hot) == [0] + [30] * 79
    long = " ".join(f"u{i}" for i in range(60000))  # the passage comes back in a very long text
    got = {r.doc_id: r for r in substring.dedup_substrings(spark.createDataFrame([(1, text), (2, long + " " + text + " " + long)], "doc_id long, text string")).collect()}
    assert got[2].n_removed == 60030 and got[2].kept_words == long


def test_substring_check_tells_colliding_hashes_apart():
    hashes, checks = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 7], np.uint32)
    h, c = substring._distinct(hashes, checks)
    assert h.tolist() == [5, 5, 9] and c.tolist() == [1, 2, 7]
    assert substring._is_in(hashes, np.array([1, 2, 3, 7], np.uint32), h, c).tolist() == [True, True, False, True]
    assert [(b, x.tolist(), y.tolist()) for b, x, y in substring._again(hashes, checks, np.array([0, 1, 2, 2]))] == [(2, [5], [1])]
    assert substring._unpack_checks(substring._pack_checks(np.array([0, 1, 0xFFFFFF], np.uint32))).tolist() == [0, 1, 0xFFFFFF]


# 4 decontamination


def brute_hits(docs, items, width=13):
    windows = {}
    for item, text in items:
        w = decontaminate.words_of(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, found = decontaminate.words_of(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out[doc] = (len(w), hit, sorted(found))
    return out


@pytest.mark.parametrize("shard_chars", [10**6, 60])
def test_decontaminate(spark, docs, shard_chars):
    rows = corpus()
    items = [(i, r[1]) for i, r in enumerate(rows[2:30:4])] + [(90, None), (91, ""), (92, "W7, w8!"), (93, rows[2][1]), (93, rows[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_hits(docs, bench, shard_chars=shard_chars, cleaned=True).collect()}
    want = brute_hits([(r[0], r[1]) for r in rows], items)
    for doc, (n, hit, found) in want.items():
        r = got[doc]
        assert (r.n_words, r.n_hit, list(r.item_ids)) == (n, len(hit), found)
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= n)
        left = [w for i, w in enumerate(decontaminate.words_of(r.text)) if i not in hit]
        assert decontaminate.words_of(r.clean_text) == left and (r.clean_text == r.text or hit)
    plan = decontaminate.find_hits(docs, bench, shard_chars=shard_chars)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # no task holds the indexes of two shards
    none = decontaminate.find_hits(docs, bench.limit(0))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(rows)
    assert decontaminate.find_hits(empty(spark), bench).count() == 0


# 10, 3 and tokens


def test_decontaminate_long_items_and_clashing_columns(spark, monkeypatch):
    """Items in segments give the same hits; columns called like outputs don't stop anything."""
    monkeypatch.setattr(decontaminate, "SEGMENT", 16)
    long = words(random.Random(8), 200, 10**6)
    items = [(1, long), (1, long), (2, long), (3, "W1 w2"), (None, long)]
    rows = [(k, "x " + " ".join(long.split()[k : k + 20]) + " y") for k in range(0, 180, 7)] + [(900, None), (901, words(random.Random(9), 50000) + " w1 w2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(rows, [i for i in items if i[0] is not None])
    for shard_chars in (10**6, 300):
        out = decontaminate.find_hits(clashing(spark, rows), bench, shard_chars=shard_chars, cleaned=True)
        got = {r.doc_id: r for r in out.collect()}
        for doc, (n, hit, found) in want.items():
            assert (got[doc].n_words, got[doc].n_hit, list(got[doc].item_ids)) == (n, len(hit), found)
            assert got[doc].quill_block == f"quill_block{doc}"
    assert decontaminate.find_hits(empty(spark), bench, cleaned=True).count() == 0


def plain_ids(text):
    tokenizer = tokens.encoder().tokenizer
    return tokenizer.encode(text or "", add_special_tokens=False).ids


TRICKY = ["", "It's the dogs' we'll I'D  don't", "<|endoftext|> x", "<|STARTOFTEXT|>", "a\u0301 e\u0301cole É ß ÄÖ ΑΣ Σ", "x\u00a0y\u2003z", "100%% ***!!! a--b_c", "漢字 🙂🙂", "\x1c\x1d a\x85b", "A" * 5000, "it's's'", "ﬁ Å \u212b", "x" * 300 + "!!", "é" * 300]


def test_encoder_equals_tokenizer():
    enc = tokens.Encoder(pieces=40)  # so small that it starts anew again and again
    batch = TRICKY + [r[1] or "" for r in corpus()]
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(batch)]
        assert got == [plain_ids(t) for t in batch]


@pytest.mark.parametrize("capacity, smallest", [(2048, 64), (2048, 8), (64, 8), (64, 1), (16, 1)])
def test_packing(docs, capacity, smallest):
    rows = corpus()
    got = packing.pack_documents(docs, capacity=capacity, smallest=smallest, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4 > 0
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, text, *_ in rows:
        want, pieces = plain_ids(text) + [1], sorted(by_doc[doc], key=lambda r: r.start)
        assert np.frombuffer(b"".join(p.ids for p in pieces), "<u4").tolist() == want
        assert [p.start for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()
        assert {p.doc_tokens for p in pieces} == {len(want)}
    total = pad = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()
        n = sum(p.length for p in pieces)
        assert n <= capacity
        total, pad = total + n, pad + (0 if n & (n - 1) == 0 else capacity - n)
    assert pad <= 0.05 * total


def test_packing_classes_hold_a_fixed_count_of_whole_documents():
    """Bins of class k have exactly k whole documents of that class and then sand; about a cut a bin, and hardly any padding."""
    rng, capacity = random.Random(6), 256
    lengths = [max(1, int(rng.lognormvariate(4.3, 0.9))) for _ in range(4000)]
    packer = packing.Packer(0, capacity, 8)
    for doc, n in enumerate(lengths):
        packer.add(doc, np.full(n, doc, "<u4").tobytes())
    closed, last = packer.next_id, len(packer.rows)
    packer.finish()
    bins = {}
    for doc, start, n, _, total, sequence, at, _ in packer.rows[:last]:
        bins.setdefault(sequence, []).append((at, doc, start, n, total))
    n_whole = 0
    for pieces in bins.values():
        pieces.sort()
        whole = [p for p in pieces if p[3] == p[4]]
        if pieces[0][3] == capacity:
            continue
        k = packing.size_class(pieces[0][4], capacity)
        first = pieces[:k]
        assert len(first) == k and all(p[3] == p[4] and capacity // (k + 1) < p[3] <= capacity // k for p in first)
        assert all(p[4] > capacity or p not in first for p in pieces[k:]) and capacity - sum(p[3] for p in pieces) < 8
        n_whole += len(whole)
    n_short = sum(n <= capacity for n in lengths)
    assert n_whole >= 0.8 * n_short
    assert len(packer.rows) - len(lengths) <= 1.6 * packer.next_id
    tokens = sum(n for *_, n in [(r[2],) for r in packer.rows])
    assert tokens == sum(lengths) and capacity * closed - sum(r[2] for r in packer.rows[:last]) <= 0.005 * tokens


def test_packing_edges(spark):
    assert packing.pack_documents(empty(spark)).count() == 0
    long = words(random.Random(1), 40000)
    got = packing.pack_documents(clashing(spark, [(1, long), (2, "w1")])).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == len(plain_ids(long)) + 1
    assert sorted({r.length for r in got if r.sequence_id == got[0].sequence_id}) == [2048]
    df = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.length) for r in packing.pack_documents(df).collect()) == [(0, 1), (1, 1), (1, 1)]


def test_best_fit_equals_brute_force():
    rng = random.Random(5)
    for _ in range(20):
        capacity = rng.choice([7, 16, 100])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(200)]
        rows = matrices.best_fit(lengths, capacity)
        assert sorted(i for r in rows for i in r) == list(range(200))
        room = []  # brute force: of the rows with enough room, one with the least
        for n in sorted(lengths, reverse=True):
            fits = [r for r in room if r >= n]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - n)
            else:
                room.append(capacity - n)
        assert sorted(capacity - sum(lengths[i] for i in r) for r in rows) == sorted(room)


@pytest.mark.parametrize("block_tokens", [2_000_000, 500])
def test_matrices(spark, docs, block_tokens):
    got = matrices.pack_matrices(docs, capacity=128, block_tokens=block_tokens).collect()
    pieces = {}
    for r in got:
        ids, positions = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(positions) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for k, (doc, start, n) in enumerate(zip(r.doc_ids, r.starts, r.lengths)):
            a, b = r.cu_seqlens[k], r.cu_seqlens[k + 1]
            assert b - a == n and positions[a:b].tolist() == list(range(n))
            pieces.setdefault(doc, []).append((start, ids[a:b].tolist()))
        assert not ids[r.n_tokens :].any()
    assert len({r.row_id for r in got}) == len(got)
    for doc, text, *_ in corpus():
        assert [i for _, p in sorted(pieces[doc]) for i in p] == plain_ids(text) + [1]
    assert matrices.pack_matrices(empty(spark)).count() == 0


@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_matrices_written_and_read_back(spark, tmp_path, dtype):
    rows = [(1, words(random.Random(1), 3000)), (None, None), (2, "w1 w2"), (2, "w1 w2")]
    matrices.write_matrices(matrices.pack_matrices(clashing(spark, rows), capacity=256, dtype=dtype), f"{tmp_path}/m")
    found = []
    for r in spark.read.parquet(f"{tmp_path}/m").collect():
        ids, positions, ends = matrices.read_matrix(r, dtype)
        assert len(ids) == len(positions) == 256
        for doc, start, a, b in zip(r.doc_ids, r.starts, ends[:-1], ends[1:]):
            assert (positions[a:b] == np.arange(b - a)).all()
            found.append((doc or 0, start, ids[a:b].tolist()))
    want = []
    for doc, text in rows:
        ids = plain_ids(text) + [1]
        want += [(doc or 0, k, ids[k : k + 256]) for k in range(0, len(ids), 256)]
    assert sorted(found) == sorted(want)
    with pytest.raises(ValueError):
        matrices.pack_matrices(clashing(spark, rows), capacity=256, end_id=70000, dtype="<u2")


# 9 URLs

URLS = [None, "", "no scheme", "http://net", "http://net/", "HTTP://A.Example.NET/en/x?y=/de/", "http://example.net/EN/", "http://x.net/fr/", "https://www.example.com/de/#a", "https://example.com/de", "https://notexample.com/de/1", "http://z.org/fr/ü", "http://z.org?/fr/", "http://a//b://c.net/x", "ftp://.net/", "http://net./", "http://ÄB.net/x", "http://" + "a." * 3000 + "net/" + "d/" * 3000]


def brute_url(url, rules):
    i = (url or "").find("://")
    host = path = ""
    if i >= 0:
        rest = url[i + 3 :]
        end = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    best = max([(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)], default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("most", [100, 0])
def test_url_filter(spark, most):
    rules = url_filter.RULES + [("example.com", "/d", "block"), ("a.example.net", "", "block")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS + URLS[5:9])], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), broadcast_rules=most).collect()}
    assert got == {i: brute_url(u, rules) for i, u in enumerate(URLS + URLS[5:9])}


def test_url_filter_empty(spark):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    got = url_filter.filter_urls(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), rules.limit(0)).collect()
    assert [(r.rule, r.verdict) for r in got] == [(None, "allow")]


# 6 fingerprints


def shingles(text, width=5):
    w = (text or "").encode().split()
    return {b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} or ({b" ".join(w)} if w else set())


def test_sketch_estimates(spark):
    rng = random.Random(2)
    base = words(rng, 3000, 5000).split()
    pairs = [("", None), ("a b", "a  b"), ("a b", ""), ("a b c d e f", "b c d e f g")]
    pairs += [(" ".join(base), " ".join(base[: 30 * k] + words(rng, 3000 - 30 * k, 5000).split())) for k in (20, 50, 90)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    from pyspark.sql import functions as F

    df = fingerprint.with_sketch(fingerprint.with_sketch(df, F.col("a"), "sa"), F.col("b"), "sb")
    df = fingerprint.with_sketch(df, F.concat_ws("\n", "a", "b"), "sab")
    got = df.select("i", "sa", "sb", fingerprint.resemblance("sa", "sb").alias("r"), fingerprint.containment("sa", "sb").alias("c"), fingerprint.distinct_shingles("sa").alias("n"), fingerprint.merge("sa", "sb").alias("m")).orderBy("i").collect()
    for r, (a, b) in zip(got, pairs):
        x, y = shingles(a), shingles(b)
        exact = len(x | y) <= fingerprint.K
        want = len(x & y) / len(x | y) if x | y else 1.0
        assert abs(r.r - want) <= (1e-12 if exact else 0.15)
        assert abs(r.c - (len(x & y) / len(x) if x else 1.0)) <= (1e-12 if exact else 0.2)
        assert abs(r.n - len(x)) <= (1e-9 if len(x) < fingerprint.K else 0.35 * len(x))
        assert list(r.m) == sorted(set(r.sa) | set(r.sb))[: fingerprint.K]


def test_fingerprint_query(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprint.op6_fingerprints(spark, str(tmp_path)).collect()}
    texts = [r[1] or "" for r in rows]
    by_text = {}
    for k, (doc, t) in enumerate(zip([r[0] for r in rows], texts)):
        follow, half = texts[(k + 1) % len(texts)], len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_next == 1.0) == (shingles(t) == shingles(follow)) or len(shingles(t) | shingles(follow)) > 128
        x, y = shingles(t), shingles(edited)
        if len(x | y) <= 128:
            assert abs(r.near_edited - (len(x & y) / len(x | y) if x | y else 1.0)) < 1e-12


@pytest.mark.parametrize("ids", [[5], [], [None, None, 7], [1, 10**12, 2, 2, 3]])
def test_next_of_odd_ids(spark, ids):
    rows = [(i, f"t{k}") for k, i in enumerate(ids)]
    got = fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["text"]).collect()
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    assert {r.text: r.next_text for r in got} == {t: order[(k + 1) % len(order)] for k, t in enumerate(order)}


# 7 languages

LANGS = {"en": "the and of to in that with from this", "fr": "le la les une des qué été même élève", "de": "der die das und nicht schön über für", "ru": "это как что все она так его"}


def language_rows(n=400):
    rng = random.Random(9)
    keys = sorted(LANGS)
    rows = [(i, " ".join(rng.choices(LANGS[keys[i % 4]].split(), k=rng.randrange(3, 40))), keys[i % 4], "s", 1, 1, "x", 1) for i in range(n)]
    return rows + [(n, None, "en", None, None, 1, "x", 1), (n + 1, " 12 !?", "en", None, None, 1, "x", 1), (n + 2, "the and of " * 200_000, None, "s", 1, 1, "x", 1)]


def test_language(spark, tmp_path):
    spark.createDataFrame(language_rows(), DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in language.op7_language_id(spark, str(tmp_path)).collect()}
    for doc, _, lang, *_ in language_rows()[:-3]:
        assert got[doc].held_out == (zlib.crc32(str(doc).encode()) % 4 == 2)
        assert got[doc].lang_pred == lang and 0 < got[doc].score <= 1
    assert [got[k].lang_pred for k in (400, 401, 402)] == ["und", "und", "en"]
    assert [got[k].score for k in (400, 401)] == [0.0, 0.0]


def test_many_languages(spark):
    """However many languages there are, all are learned, by as few as one row each."""
    rng = random.Random(12)
    rows = []
    for k in range(600):
        own = [chr(0x4E00 + 7 * k + j) for j in range(6)]
        rows += [(len(rows) + i, "".join(rng.choices(own, k=40)), f"l{k:03}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.fit(docs, sample_rows=1200)
    assert len(set(model.langs)) == 600
    got = {r.id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.97
    one = spark.createDataFrame([(1, "same text", "en")] * 3000 + [(2, "otro texto", "es")], "doc_id long, text string, lang string")
    picked, each = language.sample(one, "doc_id", "text", "lang", 100)
    assert each == 50 and picked.count() == 2  # repeated rows teach once


def test_language_prediction_equals_brute_force(spark):
    """Cosines by plain loops over n-grams of the texts, against every centroid."""
    rows = [r for r in language_rows(60)]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate((r[1], r[2]) for r in rows)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    got = {r.id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    for i, (t, _) in enumerate((r[1], r[2]) for r in rows):
        counts = language.ngram_counts([t or ""], len(model.idf))[0].tolist()
        weights = [math.log1p(c) * float(w) for c, w in zip(counts, model.idf)]
        norm = math.sqrt(sum(w * w for w in weights))
        if not norm:
            assert got[i] == ("und", 0.0)
            continue
        best = max(((sum(w * float(c) for w, c in zip(weights, centre)) / norm, -k) for k, centre in enumerate(model.centres)))
        assert got[i][0] == model.langs[-best[1]] and got[i][1] == pytest.approx(best[0], abs=1e-4)


def test_language_rejects_what_is_far_and_survives_nothing(spark):
    docs = spark.createDataFrame(language_rows(), DOCS)
    model = language.fit(docs)
    far = language.identify(spark.createDataFrame([(1, "zzzz qqqq jjjj xxxx wkwk")], "doc_id long, text string"), model).first()
    assert far.rejected and far.lang_pred in LANGS
    nothing = language.fit(docs.limit(0))
    assert language.identify(docs.limit(3), nothing).first().lang_pred == "und"
    assert language.identify(docs.limit(0), model).count() == 0


# 2 quality


def quality_rows(n=600):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = words(rng, rng.randrange(10, 80)).split()
        rows.append((i, " ".join(x + "!!" if bad and rng.random() < 0.8 else x for x in w), "en", "junk" if bad and i % 2 else "s", 9, 1, "x", 1))
        if i % 2 == 0:
            labels.append((i, int(not bad)))
    return rows + [(n, None, None, None, None, None, None, None), (None, "", "en", "s", 0, 1, "x", 1)], labels + labels[:3] + [(None, 1), (3, None)]


class PlainPool:
    """The pool as a list of (hash, features)."""

    def __init__(self, rows):
        self.of = dict(rows)

    def sure_of(self, model, sure, most, used):
        out = {}
        for view in (0, 1):
            for label in (0, 1):
                found = []
                for h, x in self.of.items():
                    z = model.logits(x[None])[view][0]
                    p = 1 / (1 + math.exp(-z))
                    if h not in used and (p >= sure if label else p <= 1 - sure):
                        found.append(h)
                out[view, label] = sorted(found)[: most[label]]
        return out

    def rows(self, hashes):
        return {h: self.of[h] for h in hashes}


def plain_features(text, source, lang, n):
    x = np.hstack([quality.text_features([text or ""]), quality.meta_features([text or ""], [source], [lang], [n])])[0]
    return int(np.array([xxhash.xxh64_intdigest(x.tobytes())], np.uint64).view(np.int64)[0]), x


def test_quality(spark):
    rows, labels = quality_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.score_quality(docs, known).collect()
    assert len(got) == len(rows) and got[0].hits in ("x", None)
    wrong = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.keep == (r.doc_id % 5 == 0)]
    assert len(wrong) <= 12
    assert not [r for r in wrong if r.doc_id % 5]  # clean ones stay
    assert all(0 <= x <= 1 for r in got for x in (r.text_score, r.meta_score, r.score))


def test_quality_equals_brute_force_and_both_views_hand_over(spark):
    rows, labels = quality_rows()
    made = quality.features(spark.createDataFrame(rows, DOCS).repartition(4))
    model = quality.fit(made, spark.createDataFrame(labels, "doc_id long, quality int"), hand_over=60)
    plain = [(r[0], *plain_features(r[1], r[3], r[2], r[4])) for r in rows]
    classes = {i: float(np.mean([q for j, q in labels if j == i and q is not None]) >= 0.5) for i, q in labels if i is not None and q is not None}
    order = sorted((p for p in plain if p[0] in classes), key=lambda p: (xxhash.xxh64_intdigest(str(p[0])), p[1]))
    x, y = np.stack([p[2] for p in order]), np.array([classes[p[0]] for p in order])
    want = quality.co_train(x, y, {p[1] for p in order}, PlainPool([p[1:] for p in plain]), 3, 60, 0.9, 10.0)
    assert model.report == want.report and model.threshold == pytest.approx(want.threshold, abs=1e-6)
    handed = {key for r in model.report for key, n in r.get("handed", {}).items() if n}
    assert {view for view, _ in handed} == {0, 1}  # either view teaches the other
    scores = sorted(zip((p[0] if p[0] is not None else -1 for p in plain), want.score(np.stack([p[2] for p in plain]))[2].tolist()))
    got = sorted((r.id if r.id is not None else -1, r.score) for r in quality.judge(made, model).collect())
    assert [i for i, _ in got] == [i for i, _ in scores]
    assert [s for _, s in got] == pytest.approx([s for _, s in scores], abs=1e-5)


def test_quality_without_labels(spark):
    rows, labels = quality_rows(20)
    docs = spark.createDataFrame(rows, DOCS)
    for known in ([], [(i, 1) for i in range(20)]):
        assert quality.score_quality(docs, spark.createDataFrame(known, "doc_id long, quality int")).where("not keep").count() == 0
    some = spark.createDataFrame(labels, "doc_id long, quality int")
    assert quality.score_quality(empty(spark), some).count() == 0


def test_quality_clashing_columns_repeated_ids_and_long_words(spark):
    rows, labels = quality_rows(200)
    rows = rows + [(4, f"w1 w2 {k}", "en", "s", 9, 1, "x", 1) for k in range(300)] + [(900, "w" * 200_000 + "!!", "en", "s", 9, 1, "x", 1)] * 2
    docs = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "lang", "source", "n_chars", "hits as Keep", "block as SCORE", "id as c0", "hits as h", "hits as x")
    out = quality.score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "c0", "h", "x", *quality.OUT]
    got = out.collect()
    assert len(got) == len(rows) and {r.h for r in got} == {"x", None}
    assert len({r.score for r in got if r.doc_id == 900}) == 1
    # the whole word counts: its end, too
    assert (quality.text_features(["w" * 100 + "!!"]) != quality.text_features(["w" * 100])).any()


# 1 scoring


def brute_scores(rows, order, alpha):
    texts = [(r[1] or "").encode().lower().split() for r in rows]
    counts = Counter(tuple(w[i : i + n]) for w in texts for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, texts))
    out = {}
    for r, w in zip(rows, texts):
        own = Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
        left = lambda g: counts[g] - own[g]
        score = 0.0
        for i in range(len(w)):
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if left(g) > 0:
                    # words of context that the document itself lacks are not given up
                    p = alpha ** (min(order, i + 1) - n) * left(g) / (left(g[:-1]) if n > 1 else total - len(w))
                    break
            else:
                p = alpha**order / (total - len(w) + 1)
            score += math.log(p)
        out[r[0]] = (len(w), score)
    return out


@pytest.mark.parametrize("order, blocks, fan_out", [(1, 1, 9), (2, 1, 9), (2, 7, 9), (3, 4, 4), (3, 30, 4)])
def test_scoring(docs, order, blocks, fan_out):
    got = {r.doc_id: (r.n_words, r.log_score) for r in scoring.score_documents(docs, order=order, blocks=blocks, fan_out=fan_out).collect()}
    want = brute_scores(corpus(), order, scoring.ALPHA)
    assert got.keys() == want.keys()
    for doc, (n, score) in want.items():
        assert got[doc][0] == n and got[doc][1] == pytest.approx(score, rel=1e-9, abs=1e-9)


def test_scoring_edges(spark):
    assert scoring.score_documents(empty(spark)).count() == 0
    one = scoring.score_documents(spark.createDataFrame([(None, "a b"), (2, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in one) == [(0, 2), (2, 0)]
    rows = [(1, words(random.Random(2), 70000)), (1, words(random.Random(3), 20)), (2, "w1 w2"), (2, "w1 w2")]
    got = scoring.score_documents(clashing(spark, rows)).collect()
    want = brute_scores([(k, t) for k, (_, t) in enumerate(rows)], scoring.ORDER, scoring.ALPHA).values()
    assert sorted(r.n_words for r in got) == [2, 2, 20, 70000]
    assert sorted(r.log_score for r in got) == pytest.approx(sorted(x for _, x in want), rel=1e-9)


# pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = [r[:5] for r in corpus(n=48)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join((rows[2][1]).split()[:15])), (2, words(random.Random(77), 30))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(r[0], int(i % 6 != 5)) for i, r in enumerate(rows)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")

    docs, steps = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.dtypes == spark.createDataFrame([], kinds).dtypes
        steps[name] = docs.collect()
        docs = spark.createDataFrame(steps[name], docs.schema)

    kept = {r.doc_id: r.text for r in steps["quality"]}
    groups = brute_links([(i, brute_fingerprint(t)) for i, t in kept.items()], 2)
    single = {i: t for i, t in kept.items() if groups[i] == i}
    assert {r.doc_id: r.text for r in steps["near_dedup"]} == single
    cut = {i: x[2].split() for i, x in brute_substring(list(single.items())).items() if not x[1] or len(x[1]) < x[0]}
    assert {r.doc_id: (r.text or "").encode().split() for r in steps["substring_dedup"]} == cut
    before = {r.doc_id: r.text for r in steps["substring_dedup"]}
    clean = {}
    for i, (n, hit, _) in brute_hits(list(before.items()), items).items():
        if not (hit and 20 * len(hit) >= n):
            clean[i] = [w for k, w in enumerate(decontaminate.words_of(before[i])) if k not in hit]
    after = {r.doc_id: r.text for r in steps["decontaminate"]}
    assert {i: decontaminate.words_of(t) for i, t in after.items()} == clean
    assert all(r.n_chars == len(r.text or "") for r in steps["decontaminate"])
    packed = {}
    for r in steps["packing"]:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == {i: len(plain_ids(t)) + 1 for i, t in after.items()}
    again = {}  # pieces differ with the tasks' shares, tokens don't
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        again[r.doc_id] = again.get(r.doc_id, 0) + r.length
    assert again == packed


def test_pipeline_clashing_columns_nulls_repeats_and_empty_tables(spark, tmp_path):
    """Further columns keep their names and values whatever they are called; odd rows and empty tables go through every stage."""
    import corpus_pipeline

    rng = random.Random(21)
    long = words(rng, 30000, 10**6)
    rows = [(k, words(rng, 40, 10**6), "en", f"s{k % 3}", 9) for k in range(30)]
    rows += [(30, None, None, None, None), (31, "", "en", "s1", 0), (32, " \n", "en", "s1", 2), (33, long, "en", "s1", len(long)), (34, rows[3][1], "en", "s0", 9), (3, rows[3][1], "en", "s0", 9), (None, rows[4][1], "en", "s1", 9)]
    named = [n for n in CLASHES if n != "id"] + ["c3", "keep_", "H", "component_id", "contaminated", "Removed_Spans"]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in named)
    df = spark.createDataFrame([(*r, *[f"{n}-{r[0]}" for n in named]) for r in rows], kinds)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, words(random.Random(5), 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, str(tmp_path)))
        if name != "packing":
            assert docs.columns == df.columns and docs.dtypes == df.dtypes
            seen[name] = docs.collect()
            assert all(r[n] == f"{n}-{r.doc_id}" for r in seen[name] for n in named)
    ids = {name: sorted((r.doc_id for r in got), key=str) for name, got in seen.items()}
    assert 34 not in ids["near_dedup"] and None in ids["near_dedup"] and {30, 31, 32, 33} & set(ids["near_dedup"])
    assert any(r.text and len(r.text) > 10**5 for r in seen["decontaminate"])
    assert docs.where("doc_id = 33").agg({"length": "sum"}).first()[0] == len(plain_ids(long)) + 1

    nothing = tmp_path / "nothing"
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{nothing}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(nothing)).count() == 0
