"""Text normalisation and segmentation (SEG) and markup sources (SRC-04, SRC-05) on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import segments
from quillspark.plans.registry import query
from quillspark.plans.views import P_CTE, SQL_NAMES, paragraphs, sql_strip, table

_NORMAL = sql_strip(r"regexp_replace(regexp_replace(replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')").replace("[\\s\\p{Z}]", "[\\s\\p{{Z}}]")
_COUNT = "(length({0}) - length(replace({0}, '{1}', '')))"
_CJK = "[一-鿿]"


@query("seg_01_normalize_text", f"SELECT doc_id, {_NORMAL.format('text')} AS normalized FROM documents")
def seg_01(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text("text").alias("normalized"))


@query("seg_02_paragraph_blocks", f"SELECT * FROM (WITH {P_CTE} SELECT doc_id, chapter_index, paragraph_index, text FROM p)")
def seg_02(spark, sf_dir):
    return paragraphs(spark, sf_dir)


# Driver texts have no headings; every 8th line of a document is made one.
_HEADED = rf"""WITH {P_CTE}, lines AS (
  SELECT doc_id, paragraph_index AS i, CASE WHEN paragraph_index % 8 = 3 THEN 'Chapter ' || chapter_index || ' ' || text ELSE text END AS line FROM p),
flags AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^Chapter[\s_\-]*\d+') THEN 1 ELSE 0 END AS h FROM lines),
runs AS (SELECT *, sum(h) OVER (PARTITION BY doc_id) AS n, sum(h) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM flags)
SELECT doc_id, CAST(CASE WHEN n >= 2 THEN c ELSE 1 END AS BIGINT) AS chapter_index, min_by(CASE WHEN n >= 2 THEN line ELSE 'Chapter 1' END, i) AS title,
  string_agg(line, chr(10) ORDER BY i) AS body
FROM runs WHERE n < 2 OR c >= 1 GROUP BY 1, 2"""


@query("seg_03_split_chapters", _HEADED)
def seg_03(spark, sf_dir):
    p = paragraphs(spark, sf_dir)
    headed = F.when(F.col("paragraph_index") % 8 == 3, F.concat(F.lit("Chapter "), F.col("chapter_index"), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    return segments.split_chapters(p.select("doc_id", F.col("paragraph_index").alias("line_no"), headed.alias("line")))


@query("seg_04_token_count", f"SELECT doc_id, CAST(greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) + len(regexp_extract_all(text, '{_CJK}'))) AS BIGINT) AS n_tokens FROM documents")
def seg_04(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count("text").cast("long").alias("n_tokens"))


_END = r"""regexp_matches({0}, '[。！？!?；;:：…\.\"”’''\)\]】]$')"""


@query("seg_05_ends_like_sentence", f"WITH {P_CTE} SELECT doc_id, paragraph_index, {_END.format('text')} AS ends FROM p")
def seg_05(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("doc_id", "paragraph_index", T.ends_like_sentence("text").alias("ends"))


@query(
    "seg_06_join_fragments",
    f"""WITH {P_CTE}, q AS (SELECT doc_id, paragraph_index, lag(CASE WHEN paragraph_index % 3 = 0 THEN text || '-' ELSE text END) OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS l, text AS r FROM p)
SELECT doc_id, paragraph_index, CASE WHEN ends_with(l, '-') THEN left(l, length(l) - 1) || r ELSE l || ' ' || r END AS joined FROM q WHERE l IS NOT NULL""",
)
def seg_06(spark, sf_dir):
    left = F.when(F.col("paragraph_index") % 3 == 0, F.concat("text", F.lit("-"))).otherwise(F.col("text"))
    q = paragraphs(spark, sf_dir).withColumn("l", F.lag(left).over(Window.partitionBy("doc_id").orderBy("paragraph_index"))).where("l is not null")
    return q.select("doc_id", "paragraph_index", T.join_fragments(F.col("l"), F.col("text")).alias("joined"))


_PAIRS = " OR ".join([_COUNT.format("text", '"') + " % 2 = 1", *[f"{_COUNT.format('text', a)} > {_COUNT.format('text', b)}" for a, b in T.PAIRS]])


@query("seg_07_unclosed_pairs", f"WITH {P_CTE} SELECT doc_id, paragraph_index, ({_PAIRS}) AS unclosed FROM p")
def seg_07(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("doc_id", "paragraph_index", T.has_unclosed_pairs("text").alias("unclosed"))


_SHIFT = " OR ".join(f"starts_with(lower(text), '{m}')" for m in T.TOPIC_MARKERS)
_DIALOGUE = " OR ".join(f"starts_with(text, '{m}')" for m in T.DIALOGUE_OPENERS)


@query(
    "seg_08_boundaries",
    f"""WITH {P_CTE} SELECT doc_id, paragraph_index, (regexp_matches(text, '^[-_=*~·•]{{3,}}$') OR starts_with(lower(text), 'scene ') OR text IN ('场景', '幕间')) AS scene,
({_SHIFT}) AS topic_shift, ({_DIALOGUE}) AS dialogue FROM p""",
)
def seg_08(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("doc_id", "paragraph_index", T.is_scene_separator("text").alias("scene"), T.is_topic_shift("text").alias("topic_shift"), T.is_dialogue_start("text").alias("dialogue"))


@query(
    "seg_09_merge_broken",
    rf"""WITH {P_CTE}, f AS (
  SELECT doc_id, paragraph_index AS i, text, regexp_matches(text, '(?i)^Chapter[\s_\-]*\d+') AS h, {_END.format('text')} AS e FROM p),
b AS (SELECT *, CASE WHEN h OR lag(h) OVER w OR lag(e) OVER w OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS brk FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b),
j AS (SELECT *, CASE WHEN i = max(i) OVER (PARTITION BY doc_id, k) THEN text WHEN ends_with(text, '-') THEN left(text, length(text) - 1) ELSE text || ' ' END AS part FROM g)
SELECT doc_id, CAST(k AS BIGINT) AS paragraph_index, string_agg(part, '' ORDER BY i) AS text FROM j GROUP BY 1, 2""",
)
def seg_09(spark, sf_dir):
    return segments.merge_broken(paragraphs(spark, sf_dir))


@query("seg_10_packets")
def seg_10(spark, sf_dir):
    return segments.packets(paragraphs(spark, sf_dir))


@query(
    "seg_11_sentences",
    rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?]*[。！？!?]|[^。！？!?]+$'), lambda x: {sql_strip('x')}), lambda x: x <> '') AS ss FROM documents)
SELECT doc_id, unnest(ss) AS sentence, unnest(range(1, len(ss) + 1)) AS sentence_index FROM s""",
)
def seg_11(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence"))
    return s.select("doc_id", "sentence", (F.col("pos") + 1).cast("long").alias("sentence_index"))


def _slug(x: str, sep: str, fallback: str, ascii_only: bool = False) -> str:
    kept = "[^a-z0-9]+" if ascii_only else "[^a-z0-9一-鿿]+"
    return f"coalesce(nullif(trim(regexp_replace(lower({sql_strip(x)}), '{kept}', '{sep}', 'g'), '{sep}'), ''), '{fallback}')"


@query("seg_12_slugify", f"WITH {P_CTE} SELECT doc_id, paragraph_index, {_slug('text', '-', 'book')} AS dashed, {_slug('text', '_', 'unknown')} AS scored, {_slug('text', '_', 'candidate', True)} AS plain FROM p")
def seg_12(spark, sf_dir):
    t = F.col("text")
    return paragraphs(spark, sf_dir).select("doc_id", "paragraph_index", T.slugify(t, "-", "book").alias("dashed"), T.slugify(t).alias("scored"), T.slugify(t, "_", "candidate", True).alias("plain"))


def _clip(x: str, limit: int, suffix: str) -> str:
    c = rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"
    return f"CASE WHEN length({c}) <= {limit} THEN {c} ELSE left({c}, {limit - len(suffix)}) || '{suffix}' END"


@query("seg_13_clip", f"SELECT doc_id, {_clip('text', 180, '...')} AS excerpt, {_clip('text', 60, '…')} AS clipped FROM documents")
def seg_13(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clip("text", 180).alias("excerpt"), T.clip("text", 60, "…").alias("clipped"))


@query("seg_14_markdown_sections")
def seg_14(spark, sf_dir):
    p = paragraphs(spark, sf_dir)
    line = F.when(F.col("paragraph_index") % 4 == 1, F.concat(F.lit("## "), F.substring("text", 1, 30))).otherwise(F.col("text"))
    return segments.snippets(segments.markdown_sections(p.select("doc_id", F.col("paragraph_index").alias("line_no"), line.alias("line"))))


@query("seg_15_drop_sections")
def seg_15(spark, sf_dir):
    p = paragraphs(spark, sf_dir)
    level = F.when(F.col("paragraph_index") % 6 == 1, F.lit("# ")).otherwise(F.when(F.col("paragraph_index") % 3 == 1, F.lit("## ")).otherwise(F.lit("")))
    return segments.drop_sections(p.select("doc_id", F.col("paragraph_index").alias("line_no"), F.concat(level, F.col("text")).alias("line")), "(?i)(the|der|la)")


@query("seg_16_long_paragraphs", rf"WITH {P_CTE} SELECT doc_id, paragraph_index, CAST(length(regexp_replace(text, '[\s\p{{Z}}]', '', 'g')) AS BIGINT) AS n_chars FROM p WHERE length(regexp_replace(text, '[\s\p{{Z}}]', '', 'g')) >= 60")
def seg_16(spark, sf_dir):
    p = paragraphs(spark, sf_dir).withColumn("n_chars", T.non_blank_length("text").cast("long"))
    return p.where("n_chars >= 60").select("doc_id", "paragraph_index", "n_chars")


_BLOCKS = r"""bare AS (SELECT doc_id, regexp_replace(text, '[\s\p{Z}]', '', 'g') AS t FROM documents),
starts AS (SELECT doc_id, t, unnest(range(1, length(t) + 1, 500)) AS s FROM bare),
blocks AS (SELECT doc_id, (s - 1) // 500 + 1 AS block_index, substring(t, s, 500) AS block FROM starts WHERE length(substring(t, s, 500)) * 2 >= 500)"""


@query("seg_17_blocks", f"WITH {_BLOCKS} SELECT * FROM blocks")
def seg_17(spark, sf_dir):
    b = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.blocks_of("text")).alias("pos", "block"))
    return b.select("doc_id", (F.col("pos") + 1).cast("long").alias("block_index"), "block")


@query("seg_18_language_guess", f"SELECT doc_id, CASE WHEN regexp_matches(text || CASE WHEN doc_id % 5 = 0 THEN '书' ELSE '' END, '{_CJK}') THEN 'zh' ELSE 'en' END AS language FROM documents")
def seg_18(spark, sf_dir):
    t = F.concat("text", F.when(F.col("doc_id") % 5 == 0, "书").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", T.language_guess(t).alias("language"))


_MARKUP = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script>', ' ', 'gis'), '<style\b[^>]*>.*?</style>', ' ', 'gis'), '</?(p|div|section|article|h[1-6]|li|blockquote|tr|br)\b[^>]*>', chr(10), 'gi'), '<[^>]+>', ' ', 'g')"
for _name, _value in T.ENTITIES:
    _MARKUP = f"replace({_MARKUP}, '{_name}', '{_value.replace(chr(39), chr(39) * 2)}')"
_PAGE_TEXT = f"page_text AS (SELECT page_id, {_NORMAL.format('t')} AS text FROM (SELECT page_id, {_MARKUP} AS t FROM pages))"


@query("src_04_markup_text", f"WITH {_PAGE_TEXT} SELECT page_id, text FROM page_text")
def src_04(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.markup_to_text("html").alias("text"))


_HINTS = " + ".join(f"CASE WHEN contains(lower(c), '{h}') THEN 1 ELSE 0 END" for h in segments.FRONT_MATTER_HINTS)


@query(
    "src_05_substantive_sections",
    rf"""WITH {_PAGE_TEXT}, s AS (
  SELECT page_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS ps FROM page_text),
f AS (SELECT page_id, array_to_string(ps, ' ') AS c, ps, coalesce(regexp_matches(ps[1], '(?i)^Chapter[\s_\-]*\d+'), false) AS h FROM s),
b AS (SELECT *, CASE WHEN h THEN ps[2:] ELSE ps END AS body FROM f),
v AS (SELECT page_id, c, h, len(ps) AS n, len(body) AS nb, length(array_to_string(body, ' ')) AS lb, coalesce(list_max(list_transform(body, lambda x: length(x))), 0) AS mx,
  len(regexp_extract_all(c, '[。！？!?\.]')) AS hits, {_HINTS} AS hints FROM b)
SELECT page_id, CASE WHEN n = 0 THEN false WHEN hints >= 2 AND mx < 200 AND length(c) < 2000 THEN false WHEN hints >= 1 AND mx < 120 AND length(c) < 900 THEN false
  WHEN length(c) >= 400 THEN true WHEN lb >= 40 AND hits >= 1 THEN true WHEN h AND lb >= 20 THEN true ELSE false END AS substantive FROM v""",
)
def src_05(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", T.paragraphs(T.markup_to_text("html"), "\n").alias("parts"))
    return pages.select("page_id", segments.is_substantive("parts").alias("substantive"))


@query("src_06_section_chapters")
def src_06(spark, sf_dir):
    """Pages as sections of books of eight."""
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 8).alias("doc_id"), (F.col("page_id") % 8 + 1).alias("chapter_index"), T.paragraphs(T.markup_to_text("html"), "\n").alias("parts"))
    return segments.section_to_chapter(pages)
