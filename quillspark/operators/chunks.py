"""Chunk assembly, the five-level hierarchy and extraction windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

# Markers of salience and tags.
CONFLICT = "fight|war|anger|fear|death|secret|against|refuse|conflict|argue|betray"
ABSTRACT = "memory|freedom|truth|fate|history|dream|identity|meaning|symbol"
QUOTES = "[\"“”‘’「」『』]"
TAGS = (("dialogue", QUOTES), ("memory", "memory|remember|past"), ("foreshadowing", "dream|future"), ("conflict", "fight|argue|war|anger"))
SALIENCE = ("emotion", "conflict", "psychological", "symbolic")


def spoiler_level(chapter: Column) -> Column:
    return F.when(chapter <= 1, 0).when(chapter <= 3, 1).otherwise(2)


def spoiler_label(level: Column) -> Column:
    return F.when(level <= 0, "safe").when(level == 1, "mild").otherwise("high")


def assemble(packets: DataFrame) -> DataFrame:
    """packets (doc_id, chapter_index, packet_index, text) -> chunk rows. token_offset sums the tokens of all packets before."""
    before = Window.partitionBy("doc_id").orderBy("chapter_index", "packet_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = packets.withColumn("tokens", T.token_count("text").cast("long")).withColumn("token_offset", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))
    level = spoiler_level(F.col("chapter_index"))
    book = F.concat(F.lit("doc-"), F.col("doc_id"))
    return rows.select(
        "doc_id",
        F.format_string("%s-c%03d-p%03d", book, "chapter_index", "packet_index").alias("chunk_id"),
        F.format_string("chapter-%03d", "chapter_index").alias("chapter_id"),
        "chapter_index",
        F.col("packet_index").alias("paragraph_index"),
        "text",
        "tokens",
        "token_offset",
        (F.col("token_offset") + F.length("text")).alias("char_end"),
        level.cast("long").alias("spoiler_level"),
        spoiler_label(level).alias("spoiler"),
        T.candidate_names("text").alias("names"),
    )


def salience(text: Column, chapter: Column) -> dict[str, Column]:
    n = F.length(text)
    sentences = F.greatest(F.lit(1), F.regexp_count(text, F.lit("[.!?。！？；;]")))
    loud, quotes = F.regexp_count(text, F.lit("[!?！？]")), F.regexp_count(text, F.lit(QUOTES))
    conflict, abstract = F.regexp_count(text, F.lit(f"(?i)({CONFLICT})")), F.regexp_count(text, F.lit(f"(?i)({ABSTRACT})"))
    raw = {
        "emotion": (n / 320 + loud * 0.18 + quotes * 0.05) / 2.0,
        "conflict": (conflict * 0.28 + loud * 0.15) / sentences,
        "psychological": (abstract * 0.22 + n / 520) / 1.5,
        "symbolic": (abstract * 0.25 + quotes * 0.08 + chapter * 0.04) / 1.4,
    }
    return {k: F.least(F.lit(1.0), T.round3(v)) for k, v in raw.items()}


def tags(text: Column) -> Column:
    low = F.lower(text)
    found = F.array_compact(F.array(*[F.when(low.rlike(p), name) for name, p in TAGS]))
    return F.when(F.size(found) > 0, F.concat(F.array(F.lit("book_text")), found)).otherwise(F.array(F.lit("book_text"), F.lit("narrative_context")))


def char_cursor(paragraphs: DataFrame) -> DataFrame:
    """Adds char_start and char_end: a running cursor with two characters between paragraphs."""
    before = Window.partitionBy("doc_id").orderBy("paragraph_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("long")
    return paragraphs.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length("text"))


def level0(paragraphs: DataFrame) -> DataFrame:
    """One row a paragraph with cursor, names, tags and salience."""
    rows = char_cursor(paragraphs).withColumn("names", T.candidate_names("text")).withColumn("tags", tags(F.col("text")))
    scores = salience(F.col("text"), F.col("chapter_index"))
    return rows.select("*", *[v.alias(k) for k, v in scores.items()])


def _ordered(value: str, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_index", value))), lambda x: x[value]), separator)


def _union(values: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(values))))


def level1(rows: DataFrame, width: int = 2) -> DataFrame:
    """Tumbling windows of ``width`` paragraphs within a chapter."""
    at = F.row_number().over(Window.partitionBy("doc_id", "chapter_index").orderBy("paragraph_index"))
    windows = rows.withColumn("window", F.floor((at - 1) / width) + 1)
    return windows.groupBy("doc_id", "chapter_index", "window").agg(
        _ordered("text", "\n\n").alias("text"),
        F.min("char_start").alias("char_start"),
        F.max("char_end").alias("char_end"),
        _union("names").alias("names"),
        _union("tags").alias("tags"),
        *[T.round3(F.avg(k)).alias(k) for k in SALIENCE],
    )


def level2(rows: DataFrame) -> DataFrame:
    """One template summary a chapter."""
    g = rows.groupBy("doc_id", "chapter_index").agg(F.min_by("text", "paragraph_index").alias("head"), F.max_by("text", "paragraph_index").alias("tail"), F.count("*").alias("n"), _union("names").alias("names"))
    listed = F.when(F.size("names") > 0, F.array_join("names", ", ")).otherwise("none yet")
    text = F.concat(
        F.lit("Chapter "), "chapter_index", F.lit(": opens with "), T.clip("head", 120), F.lit(". It develops across "), "n", F.lit(" paragraph(s) and closes with "), T.clip("tail", 120),
        F.lit(". Visible character/entity mentions: "), listed, F.lit("."),
    )
    return g.select("doc_id", "chapter_index", "n", text.alias("text"))


def level3(rows: DataFrame) -> DataFrame:
    """One global index row a book."""
    chapters = F.array_join(F.transform(F.array_sort(F.collect_set("chapter_index")), lambda c: F.format_string("ch_%03d:Chapter %d", c, c)), " | ")
    g = rows.groupBy("doc_id").agg(F.count_distinct("chapter_index").alias("chapters"), chapters.alias("map"), _union("names").alias("names"))
    listed = F.when(F.size("names") > 0, F.array_join("names", ", ")).otherwise("none detected")
    text = F.concat(
        F.lit("Global index for "), "doc_id", F.lit(". Chapters="), "chapters", F.lit(". Chapter map: "), "map", F.lit(". Known visible entities: "), listed,
        F.lit(". Designed for progress-aware retrieval and routing."),
    )
    return g.select("doc_id", "chapters", text.alias("text"))


def level4(rows: DataFrame, most: int = 2) -> DataFrame:
    """The ``most`` most quotable paragraphs of each chapter."""
    score = F.array_contains("tags", "dialogue").cast("int")
    order = [score.desc(), T.round3(F.col("emotion") + F.col("psychological")).desc(), F.length("text").desc(), F.col("paragraph_index")]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "chapter_index").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= most)


def lead_in(chunks: DataFrame, budget: int = 500) -> DataFrame:
    """For each chunk, how many chunks and tokens before it in its chapter make up at least ``budget`` tokens: those whose later
    neighbours up to the chunk have less than the budget, the crossing one included. Prefix sums turn that into an equi-join
    within the chapter."""
    w = Window.partitionBy("doc_id", "chapter_index").orderBy("paragraph_index")
    c = chunks.withColumn("through", F.sum("tokens").over(w)).withColumn("before", F.col("through") - F.col("tokens"))
    a = c.select("doc_id", "chapter_index", "paragraph_index", "before")
    b = c.select("doc_id", "chapter_index", F.col("paragraph_index").alias("p"), F.col("tokens").alias("t"), F.col("through").alias("th"))
    on = a.join(b, ["doc_id", "chapter_index"]).where((F.col("p") < F.col("paragraph_index")) & (F.col("before") - F.col("th") < budget))
    return on.groupBy("doc_id", "chapter_index", "paragraph_index").agg(F.count("*").alias("n_chunks"), F.sum("t").alias("n_tokens"))


WINDOW = "array<struct<start:bigint,n:bigint,tokens:bigint>>"


def extraction_windows(chunks: DataFrame, budget: int = 800) -> DataFrame:
    """chunks (doc_id, chapter_index, paragraph_index, tokens, forced) -> (doc_id, chapter_index, window_index, start, n, tokens).

    A window takes chunks while they fit its budget (one always) and stops before a chunk that forces a split; the next starts two thirds
    of its chunks on. Where a window starts depends on the one before, so windows are found by a fold over the chapter's
    chunks: prefix sums give each start its window, and the fold only picks the starts."""
    w = Window.partitionBy("doc_id", "chapter_index").orderBy("paragraph_index")
    rows = chunks.withColumn("i", F.row_number().over(w)).withColumn("x", F.struct("i", "paragraph_index", "tokens", "forced"))
    lists = rows.groupBy("doc_id", "chapter_index").agg(F.array_sort(F.collect_list("x")).alias("xs"))

    def grow(acc: Column, x: Column) -> Column:
        # acc: windows so far; pending rows of the open window as (start index, count, tokens, open)
        fits = (acc["n"] == 0) | ((acc["tokens"] + x["tokens"] <= budget) & ~x["forced"])
        take = acc["open"] & (x["i"] >= acc["start"]) & fits
        return F.struct(acc["start"].alias("start"), (acc["n"] + F.when(take, 1).otherwise(0)).alias("n"), (acc["tokens"] + F.when(take, x["tokens"]).otherwise(0)).alias("tokens"), (acc["open"] & (take | (x["i"] < acc["start"]))).alias("open"))

    def from_start(xs: Column, start: Column) -> Column:
        zero = F.struct(start.cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("tokens"), F.lit(True).alias("open"))
        return F.aggregate(xs, zero, grow)

    sized = lists.select("doc_id", "chapter_index", "xs", F.transform("xs", lambda x: from_start(F.col("xs"), x["i"])).alias("all"))

    def pick(acc: Column, candidate: Column) -> Column:
        due = candidate["start"] == acc["next"]
        step = F.greatest(F.lit(1), F.floor(candidate["n"] * 2 / 3)).cast("bigint")
        taken = F.array_append(acc["picked"], F.struct(candidate["start"].alias("start"), candidate["n"].alias("n"), candidate["tokens"].alias("tokens")))
        return F.struct(F.when(due, candidate["start"] + step).otherwise(acc["next"]).alias("next"), F.when(due, taken).otherwise(acc["picked"]).alias("picked"))

    start = F.struct(F.lit(1).cast("bigint").alias("next"), F.array().cast(WINDOW).alias("picked"))
    picked = sized.select("doc_id", "chapter_index", F.posexplode(F.aggregate("all", start, pick, lambda acc: acc["picked"])).alias("pos", "w"))
    return picked.select("doc_id", "chapter_index", (F.col("pos") + 1).cast("long").alias("window_index"), "w.start", "w.n", "w.tokens")


def spread_extractions(windows: DataFrame) -> DataFrame:
    """Every core chunk of a window gets its extraction; a later window overwrites an earlier one: (doc_id, chapter_index, i, window_index)."""
    rows = windows.select("doc_id", "chapter_index", "window_index", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("i"))
    return rows.groupBy("doc_id", "chapter_index", "i").agg(F.max("window_index").alias("window_index"))
