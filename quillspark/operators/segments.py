"""Segmentation operators: chapters, broken paragraphs, packets, Markdown sections, front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

# Words that mark front matter.
FRONT_MATTER_HINTS = ("cover", "contents", "copyright", "isbn", "catalog", "cip", "目录", "版权", "扉页", "封面", "出版")


def split_chapters(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line_no, line) -> (doc_id, chapter_index, title, body).

    The first heading style that a document has twice or more cuts it; text before its first heading is dropped. Other documents
    are one chapter."""
    doc = Window.partitionBy("doc_id")
    s = T.strip("line")
    flags = lines.withColumn("latin", s.rlike(T.HEADING).cast("int")).withColumn("cjk", s.rlike(T.HEADING_ZH).cast("int"))
    flags = flags.withColumn("n_latin", F.sum("latin").over(doc)).withColumn("n_cjk", F.sum("cjk").over(doc))
    heading = F.when(F.col("n_latin") >= 2, F.col("latin")).when(F.col("n_cjk") >= 2, F.col("cjk")).otherwise(F.lit(0))
    cut = (F.col("n_latin") >= 2) | (F.col("n_cjk") >= 2)
    runs = flags.withColumn("heading", heading).withColumn("cut", cut).withColumn("chapter", F.sum("heading").over(doc.orderBy("line_no")))
    runs = runs.where("not cut or chapter >= 1").withColumn("chapter_index", F.when(F.col("cut"), F.col("chapter")).otherwise(F.lit(1)).cast("long"))
    title = F.min_by(F.when(F.col("cut"), s).otherwise(F.lit("Chapter 1")), "line_no")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return runs.groupBy("doc_id", "chapter_index").agg(title.alias("title"), body.alias("body"))


def merge_broken(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, paragraph_index, text): a paragraph is glued to the one before if that doesn't end like a sentence and neither is a heading."""
    doc = Window.partitionBy("doc_id").orderBy("paragraph_index")
    flags = paragraphs.withColumn("heading", T.is_heading("text")).withColumn("ends", T.ends_like_sentence("text"))
    opens = F.col("heading") | F.coalesce(F.lag("heading").over(doc) | F.lag("ends").over(doc), F.lit(True))
    runs = flags.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(doc))
    last = F.col("paragraph_index") == F.max("paragraph_index").over(Window.partitionBy("doc_id", "run"))
    part = F.when(last, F.col("text")).when(F.endswith("text", F.lit("-")), F.substring(F.col("text"), F.lit(1), F.length("text") - 1)).otherwise(F.concat("text", F.lit(" ")))
    runs = runs.withColumn("part", part)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_index", "part"))), lambda x: x["part"]), "")
    return runs.groupBy("doc_id", F.col("run").alias("paragraph_index")).agg(text.alias("text"))


def packets(paragraphs: DataFrame, max_tokens: int = 420, max_paragraphs: int = 4) -> DataFrame:
    """(doc_id, chapter_index, packet_index, first, last, n, text, n_tokens): greedy packets of each chapter's paragraphs, which have no white space around.

    A paragraph joins the open packet if that stays within both limits, if nothing forces a split, and if the packet ends
    in mid-sentence or has a quote or bracket open. Each step depends on the packet so far, so it is a fold over the chapter's ordered
    paragraphs. All that it looks at adds up from one paragraph to the next (tokens, open pairs) or is the last one's, so it is made before, in columns, and the fold carries numbers alone;
    texts are put together at the end."""
    word = "[A-Za-z0-9_]"
    t = T.strip("text")
    facts = paragraphs.select(
        "doc_id",
        "chapter_index",
        F.struct(
            F.col("paragraph_index").alias("i"),
            t.alias("text"),
            (T.is_heading("text") | T.is_scene_separator("text") | T.is_topic_shift("text")).alias("forced"),
            T.is_dialogue_start("text").alias("dialogue"),
            T.ends_like_sentence("text").alias("ends"),
            (F.regexp_count(t, F.lit(word + "+")) + F.regexp_count(t, F.lit(T.CJK))).alias("tokens"),
            F.endswith(t, F.lit("-")).alias("hyphen"),
            (t == "-").alias("dash"),
            t.rlike("^" + word).alias("opens_word"),
            t.rlike(word + "-$").alias("cuts_word"),
            T.count_of(t, '"').cast("int").alias("quotes"),
            F.array(*[(T.count_of(t, a) - T.count_of(t, z)).cast("int") for a, z in T.PAIRS]).alias("pairs"),
        ).alias("x"),
    )
    ordered = facts.groupBy("doc_id", "chapter_index").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    packet = "struct<at:int,n:int,tokens:int,hyphen:boolean,cuts_word:boolean,ends:boolean,quotes:int,pairs:array<int>>"
    start = F.struct(F.array().cast("array<struct<at:int,n:int,tokens:int>>").alias("done"), F.lit(None).cast(packet).alias("open"), F.lit(1).alias("at"))

    def packet_of(x: Column, at: Column, n: Column, tokens: Column, cuts: Column, quotes: Column, pairs: Column) -> Column:
        return F.struct(at.alias("at"), n.alias("n"), tokens.alias("tokens"), x["hyphen"].alias("hyphen"), cuts.alias("cuts_word"), x["ends"].alias("ends"), quotes.alias("quotes"), pairs.alias("pairs"))

    def closed(now: Column) -> Column:
        return F.struct(now["at"].alias("at"), now["n"].alias("n"), now["tokens"].alias("tokens"))

    def step(acc: Column, x: Column) -> Column:
        now = acc["open"]
        # a word cut by a hyphen at a paragraph's end goes on in the next one: one token, not two
        tokens = now["tokens"] + x["tokens"] - F.when(now["hyphen"] & now["cuts_word"] & x["opens_word"], 1).otherwise(0)
        unclosed = (now["quotes"] % 2 == 1) | F.exists(now["pairs"], lambda d: d > 0)
        fits = (F.greatest(F.lit(1), tokens) <= max_tokens) & (now["n"] < max_paragraphs) & ~(x["forced"] | (x["dialogue"] & ~unclosed))
        grow = now.isNotNull() & fits & (~now["ends"] | unclosed)
        cuts = F.when(x["dash"], now["hyphen"] & now["cuts_word"]).otherwise(x["cuts_word"])
        grown = packet_of(x, now["at"], now["n"] + 1, tokens, cuts, now["quotes"] + x["quotes"], F.zip_with(now["pairs"], x["pairs"], lambda p, q: p + q))
        fresh = packet_of(x, acc["at"], F.lit(1), x["tokens"], x["cuts_word"], x["quotes"], x["pairs"])
        done = F.when(grow | now.isNull(), acc["done"]).otherwise(F.array_append(acc["done"], closed(now)))
        return F.struct(done.alias("done"), F.when(grow, grown).otherwise(fresh).cast(packet).alias("open"), (acc["at"] + 1).alias("at"))

    def text_of(p: Column) -> Column:
        part = lambda x: F.when(x["hyphen"], F.substring(x["text"], F.lit(1), F.length(x["text"]) - 1)).otherwise(F.concat(x["text"], F.lit(" ")))
        before = F.transform(F.slice("xs", p["at"], p["n"] - 1), part)
        return F.concat(F.array_join(before, ""), F.element_at("xs", p["at"] + p["n"] - 1)["text"])

    folded = ordered.withColumn("ps", F.aggregate("xs", start, step, lambda acc: F.array_append(acc["done"], closed(acc["open"]))))
    whole = F.transform("ps", lambda p: F.struct(F.element_at("xs", p["at"])["i"].alias("first"), F.element_at("xs", p["at"] + p["n"] - 1)["i"].alias("last"), p["n"].cast("long").alias("n"), text_of(p).alias("text"), F.greatest(F.lit(1), p["tokens"]).cast("long").alias("n_tokens")))
    out = folded.select("doc_id", "chapter_index", F.posexplode(whole).alias("pos", "p"))
    return out.select("doc_id", "chapter_index", (F.col("pos") + 1).cast("long").alias("packet_index"), "p.*")


def markdown_sections(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line_no, line) -> (doc_id, section, title, body): sections under headings of level 1 to 3."""
    doc = Window.partitionBy("doc_id").orderBy("line_no")
    heading = r"^#{1,3}\s+(.+?)\s*$"
    marked = lines.withColumn("title", F.when(F.col("line").rlike(heading), F.regexp_extract("line", heading, 1)))
    runs = marked.withColumn("section", F.sum(F.col("title").isNotNull().cast("int")).over(doc))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("title").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    out = runs.groupBy("doc_id", "section").agg(F.coalesce(F.max("title"), F.lit("")).alias("title"), body.alias("body"))
    return out.where(T.strip("body") != "")


def snippets(sections: DataFrame, most: int = 780) -> DataFrame:
    """Lines of each section strung together into snippets of at most ``most`` characters; a longer line is one on its own."""

    def step(acc: Column, line: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.length(last) + F.length(line) + 1 <= most)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), line)))
        return F.when(fits, grown).otherwise(F.array_append(acc, line))

    def guarded(acc: Column, line: Column) -> Column:
        return F.when(F.size(acc) == 0, F.array(line)).otherwise(step(acc, line))

    folded = F.aggregate(T.paragraphs("body", "\n"), F.array().cast("array<string>"), guarded)
    out = sections.select("doc_id", "section", "title", F.posexplode(folded).alias("pos", "snippet"))
    return out.select("doc_id", F.col("section").cast("long").alias("section"), "title", (F.col("pos") + 1).cast("long").alias("snippet_index"), "snippet")


def drop_sections(lines: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, body): Markdown without the subtrees whose heading matches ``pattern``: a dropped heading takes everything with it up to
    the next heading of its own or a higher level that doesn't match."""
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    rows = lines.select("doc_id", F.struct("line_no", "line", level.alias("level"), ((level > 0) & F.col("line").rlike(pattern)).alias("bad")).alias("x"))
    ordered = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    start = F.struct(F.lit(0).alias("under"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        ends = (x["level"] > 0) & ((acc["under"] == 0) | (x["level"] <= acc["under"]))
        under = F.when(ends & x["bad"], x["level"]).when(ends, F.lit(0)).otherwise(acc["under"])
        return F.struct(under.alias("under"), F.when(under > 0, acc["kept"]).otherwise(F.array_append(acc["kept"], x["line"])).alias("kept"))

    return ordered.select("doc_id", F.array_join(F.aggregate("xs", start, step, lambda acc: acc["kept"]), "\n").alias("body"))


def is_substantive(parts: Column | str) -> Column:
    """Whether a section's paragraphs are body text, not front matter."""
    parts = T.col(parts)
    combined, headed = F.array_join(parts, " "), F.coalesce(T.is_heading(F.get(parts, 0)), F.lit(False))
    body = F.when(headed, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)
    text = F.length(F.array_join(body, " "))
    longest = F.coalesce(F.array_max(F.transform(body, F.length)), F.lit(0))
    n = F.length(combined)
    ends = F.regexp_count(combined, F.lit(r"[。！？!?\.]"))
    hints = sum((F.contains(F.lower(combined), F.lit(h)).cast("int") for h in FRONT_MATTER_HINTS), F.lit(0))
    return (
        F.when(F.size(parts) == 0, False)
        .when((hints >= 2) & (longest < 200) & (n < 2000), False)
        .when((hints >= 1) & (longest < 120) & (n < 900), False)
        .when(n >= 400, True)
        .when((text >= 40) & (ends >= 1), True)
        .when(headed & (text >= 20), True)
        .otherwise(False)
    )


def section_to_chapter(sections: DataFrame) -> DataFrame:
    """sections (doc_id, chapter_index, parts array) -> (doc_id, chapter_index, title, body): short labels before a long paragraph go; a heading
    is the title, else the chapter's number; sections of which nothing is left go."""
    parts = F.col("parts")

    def label(i: Column) -> Column:
        here, after = F.get(parts, i), F.get(parts, i + 1)
        return (F.length(here) < 50) & (F.length(after) > 80) & ~T.is_heading(here) & ~here.rlike(r"[。！？!?\.]")

    # filters sink below the columns that they read and take those columns' expressions along, one copy a place: into a lambda they would be made anew for each element
    sections = T.made_once(sections.select("doc_id", "chapter_index", "parts"), "parts").where(F.size("parts") > 0)
    places = F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0)))
    leading = F.aggregate(places, F.lit(0), lambda n, i: F.when((n == i) & F.coalesce(label(i), F.lit(False)), n + 1).otherwise(n))
    rows = T.made_once(sections.withColumn("leading", leading), "leading").withColumn("parts", F.slice(parts, F.col("leading") + 1, F.size(parts))).drop("leading")
    rows = T.made_once(rows, "parts")
    first = F.get("parts", 0)
    rows = T.made_once(rows.withColumn("title", F.when(T.is_heading(first), first).otherwise(F.concat(F.lit("Chapter "), "chapter_index"))), "title")
    body = F.filter(F.when(T.is_heading(first), F.slice("parts", 2, F.greatest(F.size("parts"), F.lit(1)))).otherwise(F.col("parts")), lambda p: p != F.col("title"))
    rows = T.made_once(rows.withColumn("body", body), "body")
    return rows.where(F.size("body") > 0).select("doc_id", "chapter_index", "title", F.array_join("body", "\n").alias("body"))
