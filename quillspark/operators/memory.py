"""Memory layer: registry, layered memories, retrieval documents, audits and maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

# Words that are no themes, and characters that no frequent n-gram may hold.
THEME_STOPWORDS = ("我们", "他们", "这个", "那个", "自己", "因为", "所以", "但是", "没有", "一个")
BLOCKED_CHARS = "的一是在了和与及或也都就而并把被对从中为有无不说这那其我你他她它们可但什"
CJK_RUN = r"[\x{4e00}-\x{9fff}]"


def registry(mentions: DataFrame, texts: DataFrame, most: int = 80) -> DataFrame:
    """mentions (doc_id, paragraph_index, ord, name, slug), texts (doc_id, paragraph_index, text) -> (doc_id, slug, n_mentions, spans): where
    in its paragraph each mention first stands (from 0), at most ``most`` spans an entity, in reading order."""
    m = mentions.join(texts, ["doc_id", "paragraph_index"]).withColumn("at", F.nullif(F.instr("text", F.col("name")), F.lit(0)) - 1)
    span = F.struct("paragraph_index", "ord", "at")
    g = m.groupBy("doc_id", "slug").agg(F.count("*").alias("n_mentions"), F.slice(F.array_sort(F.collect_list(span)), 1, most).alias("spans"))
    return g


def theme_terms(texts: DataFrame, most: int = 12) -> DataFrame:
    """texts (doc_id, ord, text) -> (doc_id, term, n, rank): greedy runs of 2 to 4 CJK characters; ties by first appearance."""
    runs = texts.select("doc_id", "ord", F.posexplode(F.regexp_extract_all("text", F.lit(CJK_RUN + "{2,4}"), F.lit(0))).alias("pos", "term"))
    g = runs.where(~F.col("term").isin(*THEME_STOPWORDS)).groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min(F.struct("ord", "pos")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")).cast("long")
    return g.select("doc_id", "term", "n", rank.alias("rank")).where(F.col("rank") <= most)


def salience(text: Column, markers: list[str]) -> Column:
    """0.15 for each marker that a text has, and for its length up to 0.4."""
    n = sum((F.contains(text, F.lit(m)).cast("int") for m in markers), F.lit(0))
    return T.round3(F.least(F.lit(1.0), 0.15 * n + F.least(F.length(text) / 800, F.lit(0.4))))


def layered_memories(chunks: DataFrame, mentions: DataFrame, entities: DataFrame, edges: DataFrame, themes: DataFrame, theme_texts: DataFrame, markers: list[str]) -> DataFrame:
    """(doc_id, memory_id, memory_type, title, summary, chapter_index, paragraph_index, entity_ids, relation_ids, evidence, salience) of four layers: episodes (chunks), chapters, arcs of
    characters and arcs of themes.

    chunks (doc_id, chapter_index, paragraph_index, text), mentions (doc_id, paragraph_index, ord, slug), entities (doc_id, slug, name, type, mention_count, first_chapter, last_chapter, last_paragraph),
    edges (doc_id, source, target, valid_at), themes (doc_id, term, n, rank), theme_texts (doc_id, paragraph_index, text): where terms are looked for. A chapter lists the first 18 ids, by name, of those whose
    lifespan covers it; lifespans expand to chapters, so that the range join is an equi-join."""
    none = F.array().cast("array<string>")
    sal = chunks.withColumn("salience", salience(F.col("text"), markers))
    of_chunk = mentions.groupBy("doc_id", "paragraph_index").agg(F.array_sort(F.collect_set("slug")).alias("entity_ids"))
    rel_of = edges.groupBy("doc_id", F.col("valid_at").alias("paragraph_index")).agg(F.array_sort(F.collect_set(F.concat_ws("|", "source", "target"))).alias("relation_ids"))

    def out(df: DataFrame, kind: str, memory_id: Column, title: Column, summary: Column, paragraph: Column, entity_ids: Column, relation_ids: Column, evidence: Column, value: Column) -> DataFrame:
        return df.select(
            "doc_id", memory_id.alias("memory_id"), F.lit(kind).alias("memory_type"), title.alias("title"), summary.alias("summary"), F.col("chapter_index").cast("long").alias("chapter_index"),
            paragraph.cast("long").alias("paragraph_index"), entity_ids.alias("entity_ids"), relation_ids.alias("relation_ids"), evidence.alias("evidence"), value.alias("salience"),
        )

    p = F.col("paragraph_index").cast("string")
    seen = sal.join(of_chunk, ["doc_id", "paragraph_index"], "left").join(rel_of, ["doc_id", "paragraph_index"], "left")
    title = F.concat(F.lit("Chapter "), F.col("chapter_index").cast("string"), F.lit(" paragraph "), p)
    episode = out(seen, "episode", F.concat(F.lit("episode::"), p), title, T.clip("text", 220, "…"), F.col("paragraph_index"), F.coalesce("entity_ids", none), F.coalesce("relation_ids", none), F.array(p), F.col("salience"))

    k = F.row_number().over(Window.partitionBy("doc_id", "chapter_index").orderBy("paragraph_index"))
    heads = sal.withColumn("k", k)
    xs = F.array_sort(F.collect_list(F.when(F.col("k") <= 8, F.struct("paragraph_index", "text"))))
    chapters = heads.groupBy("doc_id", "chapter_index").agg(xs.alias("xs"), F.max("salience").alias("salience"))
    alive = entities.select("doc_id", "slug", F.explode(F.sequence("first_chapter", "last_chapter")).alias("chapter_index"))
    listed = alive.groupBy("doc_id", "chapter_index").agg(F.slice(F.array_sort(F.collect_set("slug")), 1, 18).alias("entity_ids"))
    chapters = chapters.join(listed, ["doc_id", "chapter_index"], "left")
    name = F.lpad(F.col("chapter_index").cast("string"), 3, "0")
    text = F.array_join(F.transform("xs", lambda x: x["text"]), " ")
    at = F.transform("xs", lambda x: x["paragraph_index"].cast("string"))
    chapter = out(chapters, "chapter", F.concat(F.lit("chapter::"), name), F.concat(F.lit("Chapter "), F.col("chapter_index").cast("string")), T.clip(text, 360, "…"), F.lit(None), F.coalesce("entity_ids", none), none, at, F.col("salience"))

    first_ten = F.slice(F.array_sort(F.collect_list(F.struct("paragraph_index", "ord"))), 1, 10)
    places = mentions.groupBy("doc_id", "slug").agg(first_ten.alias("xs"))
    arcs = entities.where("type = 'character'").join(places, ["doc_id", "slug"]).withColumn("chapter_index", F.col("last_chapter"))
    appears = F.concat("name", F.lit(" appears from chapter "), F.col("first_chapter").cast("string"), F.lit("."))
    value = T.round3(F.least(F.lit(1.0), 0.25 + F.col("mention_count") / 20))
    character = out(arcs, "character_arc", F.concat(F.lit("character::"), "slug"), F.col("name"), appears, F.col("last_paragraph"), F.array("slug"), none, at, value)

    top = themes.where("rank <= 8")
    has = top.join(theme_texts.select("doc_id", "paragraph_index", F.col("text").alias("t")), "doc_id").where(F.contains("t", "term"))
    has = has.groupBy("doc_id", "term", "n").agg(F.slice(F.array_sort(F.collect_list("paragraph_index")), 1, 8).alias("ps")).withColumn("chapter_index", F.lit(1))
    line = F.concat(F.lit("主题词“"), "term", F.lit("”在当前文本中出现 "), F.col("n").cast("string"), F.lit(" 次，可作为阅读线索。"))
    theme = out(has, "theme_arc", F.concat(F.lit("theme::"), "term"), F.col("term"), line, F.lit(None), none, none, F.transform("ps", lambda x: x.cast("string")), T.round3(F.least(F.lit(1.0), F.col("n") / 20)))
    return episode.unionByName(chapter).unionByName(character).unionByName(theme)


def retrieval_documents(chunks: DataFrame, entities: DataFrame, relations: DataFrame, memories: DataFrame) -> DataFrame:
    """(doc_id, document_id, source_type, chapter_index, paragraph_index, text): everything that a search may find. chunks (doc_id, chapter_index, paragraph_index, text), entities (doc_id, slug, name, aliases,
    summary, first_chapter, first_paragraph), relations (doc_id, source, target, fact, valid_chapter, valid_paragraph), memories of layered_memories()."""

    def rows(df: DataFrame, document_id: Column, kind: Column, chapter: str, paragraph: str, text: Column) -> DataFrame:
        return df.select("doc_id", document_id.alias("document_id"), kind.alias("source_type"), F.col(chapter).cast("long").alias("chapter_index"), F.col(paragraph).cast("long").alias("paragraph_index"), text.alias("text"))

    searchable = F.array_join(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")), F.array(F.coalesce("summary", F.lit("")))), " ")
    parts = [
        rows(chunks, F.concat(F.lit("chunk::p"), F.col("paragraph_index").cast("string")), F.lit("book_text"), "chapter_index", "paragraph_index", F.col("text")),
        rows(entities, F.concat(F.lit("entity::"), "slug"), F.lit("entity"), "first_chapter", "first_paragraph", searchable),
        rows(relations, F.concat(F.lit("relation::"), "source", F.lit("|"), "target"), F.lit("relation"), "valid_chapter", "valid_paragraph", F.col("fact")),
        rows(memories, F.col("memory_id"), F.concat(F.lit("memory_"), "memory_type"), "chapter_index", "paragraph_index", F.concat("title", F.lit("\n"), "summary")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def entity_list(entities: DataFrame, terms: list[str], entity_type: str | None = None, chapter: int | None = None) -> DataFrame:
    """Entities (doc_id, slug, name, aliases, summary, type, mention_count, first_chapter, last_chapter) of a type that have been seen by a chapter and hold any of the terms (in small letters) in name, aliases or
    summary, with their rank in the book by (mentions, last chapter), ties by name."""
    text = F.lower(F.array_join(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")), F.array(F.coalesce("summary", F.lit("")))), " "))
    rows = entities if entity_type is None else entities.where(F.col("type") == entity_type)
    rows = rows if chapter is None else rows.where(F.col("first_chapter") <= chapter)
    rows = rows.where(T.any_of([F.contains(text, F.lit(t)) for t in terms])) if terms else rows
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("mention_count"), F.desc("last_chapter"), "slug")).cast("long")
    return rows.withColumn("rank", rank)


def entity_detail(wanted: DataFrame, entities: DataFrame, relations: DataFrame, memories: DataFrame) -> DataFrame:
    """(doc_id, slug, kind, key, text): of the wanted (doc_id, slug) all relations at either end, by their names, and the memories of their arc; an end that is no entity keeps its id."""
    names = entities.select("doc_id", "slug", "name")
    ends = {c: names.select("doc_id", F.col("slug").alias(c), F.col("name").alias(f"{c}_name")) for c in ("source", "target")}
    around = relations.withColumn("slug", F.explode(F.array_distinct(F.array("source", "target")))).join(wanted, ["doc_id", "slug"], "left_semi")
    around = around.join(ends["source"], ["doc_id", "source"], "left").join(ends["target"], ["doc_id", "target"], "left")
    text = F.concat_ws(" ", F.coalesce("source_name", "source"), "relation_type", F.coalesce("target_name", "target"), "status", F.concat(F.lit("p"), F.col("valid_paragraph").cast("string")))
    told = around.select("doc_id", "slug", F.lit("relation").alias("kind"), F.concat_ws("|", "source", "target").alias("key"), text.alias("text"))
    arcs = memories.where("memory_type = 'character_arc'").select("doc_id", F.explode("entity_ids").alias("slug"), "memory_id", "summary").join(wanted, ["doc_id", "slug"], "left_semi")
    return told.unionByName(arcs.select("doc_id", "slug", F.lit("memory").alias("kind"), F.col("memory_id").alias("key"), F.col("summary").alias("text")))


# Why an index may be less than ready.
NO_GRAPH = "graph_missing"
NO_EMBEDDING = "embedding runtime is not configured"
NO_ENDPOINT = "configured LLM provider/model does not expose an embeddings endpoint; using keyword and graph retrieval"
NO_ENTITIES = "graph has no resolved entities; rebuild with graph extractor credentials for full memory quality"


def index_status(books: DataFrame) -> DataFrame:
    """books (doc_id, has_graph, n_entities, embedding: none, no_endpoint, ready, or failed: and a message) -> (doc_id, status, reasons): all that is amiss, in order, each reason once."""
    e = F.col("embedding")
    reasons = F.array_distinct(F.array_compact(F.array(
        F.when(~F.col("has_graph"), NO_GRAPH),
        F.when(e == "none", NO_EMBEDDING).when(e == "no_endpoint", NO_ENDPOINT).when(F.startswith(e, F.lit("failed: ")), F.concat(F.lit("embedding API failed: "), F.substring(e, F.lit(9), F.length(e)))),
        F.when(~F.col("has_graph") | (F.coalesce("n_entities", F.lit(0)) == 0), NO_ENTITIES),
    )))
    return books.select("doc_id", F.when(F.size(reasons) > 0, "degraded").otherwise("ready").alias("status"), reasons.alias("reasons"))


def memory_map(entities: DataFrame, edges: DataFrame, memories: DataFrame, scope: str, chapter: int, paragraph: int = 0, seeds: DataFrame | None = None, limit: int = 18) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, cards) of each book for a scope: chapter, passage, book, or character with ``seeds`` (doc_id, slug), one a book.

    entities (doc_id, slug, mention_count, first_chapter, first_paragraph, last_chapter), edges (doc_id, source, target, weight, valid_chapter, valid_paragraph), memories as layered_memories() makes
    them. Nodes by mentions, edges by weight, cards by salience, ties by name."""
    order = [F.desc("mention_count"), F.col("slug")]
    seen = edges.where(F.col("valid_chapter") <= chapter)

    def best(df: DataFrame, by: list[Column], most: int) -> DataFrame:
        return df.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*by)).cast("long")).where(F.col("place") <= most)

    if scope == "character":
        around = seen.join(seeds.withColumnRenamed("slug", "seed"), "doc_id").where("source = seed or target = seed")
        near = around.select("doc_id", F.explode(F.array("source", "target")).alias("slug"), "seed").where("slug <> seed").select("doc_id", "slug").distinct()
        near = best(near.join(entities, ["doc_id", "slug"]), order, max(limit - 1, 0)).drop("place")
        nodes = near.unionByName(entities.join(seeds, ["doc_id", "slug"], "left_semi").select(*near.columns))
    else:
        pool = entities.where(F.col("first_chapter") <= chapter)
        if scope == "passage" and paragraph:
            pool = pool.where((F.col("first_chapter") < chapter) | (F.col("first_paragraph") <= paragraph))
        elif scope == "chapter":
            pool = pool.where(F.col("last_chapter") >= chapter)
        nodes = best(pool, order, limit).drop("place")
    shown = seen.where((F.col("valid_chapter") < chapter) | (F.col("valid_paragraph") <= paragraph)) if paragraph else seen
    links = best(induced(nodes, shown), [F.desc("weight"), F.col("source"), F.col("target")], max(limit + 6, 12))
    cards = memories if scope == "character" else memories.where(F.col("chapter_index") <= chapter)
    if seeds is not None:
        cards = cards.join(seeds, "doc_id").where(F.array_contains("entity_ids", F.col("slug"))).drop("slug")
    kinds = {"chapter": ("chapter", "theme_arc", "character_arc"), "passage": ("episode", "chapter")}.get(scope)
    cards = cards.where(F.col("memory_type").isin(*kinds)) if kinds else cards
    return best(nodes, order, limit), links, best(cards, [F.desc("salience"), F.col("memory_id")], 8)


def frequent_ngrams(texts: DataFrame) -> DataFrame:
    """(doc_id, token, weight): 2- to 4-grams of CJK runs without blocked characters, weight 1 + 0.18 for each character beyond two; Latin
    words of three letters or more, in small letters, weight 1. Runs are cut at 80 characters.

    A book's texts are smaller than its n-grams, so those are what moves, to one task in order of books; counts then are whole and never move. They are made in arrays of numbers, a
    block of whole books at a time, so that memory is a block or one book, whichever is more."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.where("text is not null").select("doc_id", "text").repartition(parts, "doc_id").sortWithinPartitions("doc_id")
    return rows.mapInArrow(_count_books, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, token string, weight double")


def _count_books(batches: Iterator[pa.RecordBatch], block: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    ids, texts, size = [], [], 0
    for b in batches:
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if size >= block and d != ids[-1]:
                yield from _count_block(ids, texts, b.schema.field(0).type)
                ids, texts, size = [], [], 0
            ids.append(d)
            texts.append(t)
            size += len(t) + 1
            kind = b.schema.field(0).type
    if ids:
        yield from _count_block(ids, texts, kind)


def _count_block(ids: list, texts: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """ids in order, one a text."""
    row = np.zeros(len(ids), np.int64)
    row[1:] = np.cumsum([a != b for a, b in zip(ids[1:], ids)])
    books = pa.array([ids[i] for i in np.flatnonzero(np.diff(row, prepend=-1))], kind)
    c = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    book = np.repeat(row, np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    cjk = (c >= 0x4E00) & (c <= 0x9FFF)
    alphabet = np.unique(c[cjk])
    bits, book_bits = max(1, (len(alphabet) - 1).bit_length()), max(0, (len(books) - 1).bit_length())
    if 4 * bits + book_bits > 63 and len(books) > 1:
        at = int(np.searchsorted(row, len(books) // 2))
        yield from _count_block(ids[:at], texts[:at], kind)
        yield from _count_block(ids[at:], texts[at:], kind)
        return

    def out(books_of: np.ndarray, tokens: pa.Array, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
        whole = pa.RecordBatch.from_arrays([books.take(pa.array(books_of)), tokens, pa.array(weight)], ["doc_id", "token", "weight"])
        for i in range(0, whole.num_rows, 1 << 16):
            yield whole.slice(i, 1 << 16)

    if len(alphabet):
        place = np.arange(len(c))
        start = np.maximum.accumulate(np.where(cjk, 0, place + 1))  # where the run that a character stands in begins
        in_piece = (place - start) % 80  # nothing reaches across a cut
        free = cjk & ~np.isin(c, np.array([ord(x) for x in BLOCKED_CHARS], np.uint32))
        rank = np.zeros(len(c), np.int64)
        rank[cjk] = np.searchsorted(alphabet, c[cjk])
        good, key = free, rank
        for n in (2, 3, 4):
            good, key = good[:-1] & free[n - 1 :], (key[:-1] << bits) | rank[n - 1 :]
            at = np.flatnonzero(good & (in_piece[: len(good)] + n <= 80))
            keys, counts = np.unique((book[at] << (n * bits)) | key[at], return_counts=True)
            if not len(keys):
                continue
            chars = alphabet[np.stack([(keys >> (bits * (n - 1 - j))) & ((1 << bits) - 1) for j in range(n)], axis=1)]
            utf8 = np.stack([0xE0 | (chars >> 12), 0x80 | ((chars >> 6) & 0x3F), 0x80 | (chars & 0x3F)], axis=2).astype(np.uint8)
            ends = np.arange(len(keys) + 1, dtype=np.int32) * (3 * n)
            tokens = pa.StringArray.from_buffers(len(keys), pa.py_buffer(ends), pa.py_buffer(utf8.tobytes()))
            yield from out(keys >> (n * bits), tokens, counts * (1 + (n - 2) * 0.18))

    low = c | 0x20
    letter = (low >= 97) & (low <= 122) & (c < 128)
    inside = letter | (c == 39) | (c == 45)
    edges = np.diff(inside.astype(np.int8), prepend=0)
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)  # the last character is a line's end
    letters = np.flatnonzero(letter)
    if len(letters):
        begin = np.append(letters, len(c))[np.searchsorted(letters, first)]  # a word begins at the first letter of its run
        long = last - begin >= 3
        begin, last = begin[long], last[long]
    if len(letters) and len(begin):
        mark = np.zeros(len(c) + 1, np.int8)
        mark[begin] = 1
        mark[last] -= 1
        data = np.where(letter, low, c)[np.cumsum(mark[:-1]) > 0].astype(np.uint8)
        ends = np.append(0, np.cumsum(last - begin)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(data.tobytes())).dictionary_encode()
        keys, counts = np.unique(book[begin] * len(words.dictionary) + words.indices.to_numpy(), return_counts=True)
        yield from out(keys // len(words.dictionary), words.dictionary.take(pa.array(keys % len(words.dictionary))), counts * 1.0)


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are both among the nodes (doc_id, slug)."""
    one = edges.join(nodes.select("doc_id", F.col("slug").alias("source")), ["doc_id", "source"], "left_semi")
    return one.join(nodes.select("doc_id", F.col("slug").alias("target")), ["doc_id", "target"], "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    a = edges.join(nodes.select("doc_id", F.col("slug").alias("source")), ["doc_id", "source"], "left_anti").select(*edges.columns)
    b = edges.join(nodes.select("doc_id", F.col("slug").alias("target")), ["doc_id", "target"], "left_anti").select(*edges.columns)
    return a.union(b).distinct()


def signature_score(sentence: Column, style: list[str], weak: list[str], judgement: list[str], chapter: Column, paragraph: Column, names: Column, graph: Column) -> Column:
    """Length near 34, style terms, names, graph centrality, judgement and place count for a sentence; weak terms against it."""
    n = F.length(sentence)
    count = lambda words: sum((F.contains(sentence, F.lit(w)).cast("int") for w in words), F.lit(0))
    base = (1.0 - F.least(F.abs(n - 34) / 58, F.lit(1.0))) * 2.0 + count(style) * 1.35 - count(weak) * 0.42
    judged = F.when(sentence.rlike("|".join(judgement)), 0.9).otherwise(0.0) + F.when(sentence.rlike("[，；,;]"), 0.35).otherwise(0.0)
    place = 0.16 / F.greatest(chapter, F.lit(1)) + 0.06 / F.greatest(paragraph, F.lit(1))
    return F.when((n < 10) | (n > 92), -20.0).otherwise(base + names + F.least(graph, F.lit(8)) * 0.22 + judged + place)
