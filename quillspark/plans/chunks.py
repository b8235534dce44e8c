"""Chunk construction (CHK) and extraction windows (EXT) over the documents' paragraphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunks as C
from quillspark.operators import graph as G
from quillspark.plans.registry import query
from quillspark.plans.views import M_CTE, P_CTE, mentions, paragraphs, table

_CJK = "[一-鿿]"
_TOKENS = f"CAST(greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) + len(regexp_extract_all(text, '{_CJK}'))) AS BIGINT)"
_R3 = "floor(({}) * 1000 + 0.5) / 1000"
PK_CTE = f"{P_CTE}, pk AS (SELECT doc_id, chapter_index, row_number() OVER (PARTITION BY doc_id, chapter_index ORDER BY paragraph_index) AS packet_index, text, {_TOKENS} AS tokens FROM p)"


def packets(spark, sf_dir):
    at = F.row_number().over(Window.partitionBy("doc_id", "chapter_index").orderBy("paragraph_index")).cast("long")
    return paragraphs(spark, sf_dir).withColumn("packet_index", at).drop("paragraph_index")


@query(
    "chk_01_chunks",
    f"""WITH {PK_CTE} SELECT format('doc-{{}}-c{{:03d}}-p{{:03d}}', doc_id, chapter_index, packet_index) AS chunk_id, format('chapter-{{:03d}}', chapter_index) AS chapter_id, tokens,
CAST(coalesce(sum(tokens) OVER w, 0) AS BIGINT) AS token_offset, CAST(coalesce(sum(tokens) OVER w, 0) + length(text) AS BIGINT) AS char_end FROM pk
WINDOW w AS (PARTITION BY doc_id ORDER BY chapter_index, packet_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def chk_01(spark, sf_dir):
    return C.assemble(packets(spark, sf_dir)).select("chunk_id", "chapter_id", "tokens", "token_offset", "char_end")


@query("chk_02_spoiler_level", f"WITH {P_CTE} SELECT doc_id, paragraph_index, CASE WHEN chapter_index <= 1 THEN 'safe' WHEN chapter_index <= 3 THEN 'mild' ELSE 'high' END AS spoiler FROM p")
def chk_02(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("doc_id", "paragraph_index", C.spoiler_label(C.spoiler_level(F.col("chapter_index"))).alias("spoiler"))


@query("chk_03_candidate_characters", f"WITH {M_CTE} SELECT doc_id, paragraph_index, string_agg(name, ',' ORDER BY ord) AS names FROM m GROUP BY 1, 2")
def chk_03(spark, sf_dir):
    names = T.candidate_names("text")
    return paragraphs(spark, sf_dir).where(F.size(names) > 0).select("doc_id", "paragraph_index", F.array_join(names, ",").alias("names"))


@query(
    "chk_04_coerce_records",
    "SELECT doc_id, coalesce(nullif(trim(source), ''), 'untitled') AS title, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'en' END AS language, CASE WHEN n_chars > 1000 THEN 'novel' ELSE 'essay' END AS kind, 'book_' || coalesce(nullif(lower(trim(source)), ''), 'untitled') || '_' || doc_id AS record_id FROM documents",
)
def chk_04(spark, sf_dir):
    title = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("untitled"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        title.alias("title"),
        F.when(F.col("lang").isin("en", "fr"), F.col("lang")).otherwise("en").alias("language"),
        F.when(F.col("n_chars") > 1000, "novel").otherwise("essay").alias("kind"),
        F.concat(F.lit("book_"), F.lower(title), F.lit("_"), F.col("doc_id")).alias("record_id"),
    )


_CUR = f"""cur AS (SELECT *, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY paragraph_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM p)"""


@query("chk_05_char_cursor", f"WITH {P_CTE}, {_CUR} SELECT doc_id, paragraph_index, char_start, char_start + length(text) AS char_end FROM cur")
def chk_05(spark, sf_dir):
    return C.char_cursor(paragraphs(spark, sf_dir)).select("doc_id", "paragraph_index", "char_start", "char_end")


def _n(pattern, flags=""):
    return f"len(regexp_extract_all(text, '{flags}{pattern}'))"


_LOUD, _Q, _CON, _ABS = _n("[!?！？]"), _n(C.QUOTES), _n(f"({C.CONFLICT})", "(?i)"), _n(f"({C.ABSTRACT})", "(?i)")
_SAL = {
    "emotion": f"(length(text) / 320 + {_LOUD} * 0.18::DOUBLE + {_Q} * 0.05::DOUBLE) / 2.0::DOUBLE",
    "conflict": f"({_CON} * 0.28::DOUBLE + {_LOUD} * 0.15::DOUBLE) / greatest(1, {_n('[.!?。！？；;]')})",
    "psychological": f"({_ABS} * 0.22::DOUBLE + length(text) / 520) / 1.5::DOUBLE",
    "symbolic": f"({_ABS} * 0.25::DOUBLE + {_Q} * 0.08::DOUBLE + chapter_index * 0.04::DOUBLE) / 1.4::DOUBLE",
}
_TAGS = "list_filter(list_value('book_text', " + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in C.TAGS) + f", CASE WHEN NOT ({' OR '.join(f'regexp_matches(lower(text), {chr(39)}{p}{chr(39)})' for _, p in C.TAGS)}) THEN 'narrative_context' END), lambda x: x IS NOT NULL)"
# names come from m, where order and distinctness are explicit
L0_CTE = f"{M_CTE}, {_CUR}, nm AS (SELECT doc_id, paragraph_index, list(name ORDER BY ord) AS names FROM m GROUP BY 1, 2), l0 AS (SELECT cur.*, char_start + length(text) AS char_end, coalesce(names, []) AS names, {_TAGS} AS tags, " + ", ".join(f"least(1.0::DOUBLE, {_R3.format(v)}) AS {k}" for k, v in _SAL.items()) + " FROM cur LEFT JOIN nm USING (doc_id, paragraph_index))"


@query("chk_06_salience", f"WITH {P_CTE} SELECT doc_id, paragraph_index, " + ", ".join(f"least(1.0::DOUBLE, {_R3.format(v)}) AS {k}" for k, v in _SAL.items()) + " FROM p")
def chk_06(spark, sf_dir):
    scores = C.salience(F.col("text"), F.col("chapter_index"))
    return paragraphs(spark, sf_dir).select("doc_id", "paragraph_index", *[v.alias(k) for k, v in scores.items()])


@query("chk_07_tags", f"WITH {P_CTE} SELECT doc_id, paragraph_index, array_to_string({_TAGS}, ',') AS tags FROM p")
def chk_07(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("doc_id", "paragraph_index", F.array_join(C.tags(F.col("text")), ",").alias("tags"))


@query("chk_08_level0", f"WITH {L0_CTE} SELECT format('chunk_{{}}_{{:03d}}_{{:04d}}', doc_id, chapter_index, paragraph_index) AS chunk_id, char_start, char_end, array_to_string(names, ',') AS names, array_to_string(tags, ',') AS tags, emotion FROM l0")
def chk_08(spark, sf_dir):
    rows = C.level0(paragraphs(spark, sf_dir))
    return rows.select(F.format_string("chunk_%d_%03d_%04d", "doc_id", "chapter_index", "paragraph_index").alias("chunk_id"), "char_start", "char_end", F.array_join("names", ",").alias("names"), F.array_join("tags", ",").alias("tags"), "emotion")


@query(
    "chk_09_level1",
    f"""WITH {L0_CTE}, w AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, chapter_index ORDER BY paragraph_index) - 1) // 2 + 1 AS win FROM l0)
SELECT doc_id, chapter_index, win AS window_index, string_agg(text, chr(10) || chr(10) ORDER BY paragraph_index) AS text, min(char_start) AS char_start, max(char_end) AS char_end,
  array_to_string(list_sort(list_distinct(flatten(list(names)))), ',') AS names, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags, {_R3.format('avg(emotion)')} AS emotion
FROM w GROUP BY 1, 2, 3""",
)
def chk_09(spark, sf_dir):
    rows = C.level1(C.level0(paragraphs(spark, sf_dir)))
    return rows.select("doc_id", "chapter_index", F.col("window").alias("window_index"), "text", "char_start", "char_end", F.array_join("names", ",").alias("names"), F.array_join("tags", ",").alias("tags"), "emotion")


def _sql_clip(x, n=120):
    c = rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE left({c}, {n - 3}) || '...' END"


@query(
    "chk_10_level2",
    f"""WITH {L0_CTE}, g AS (SELECT doc_id, chapter_index, min_by(text, paragraph_index) AS head, max_by(text, paragraph_index) AS tail, count(*) AS n, list_sort(list_distinct(flatten(list(names)))) AS names FROM l0 GROUP BY 1, 2)
SELECT doc_id, chapter_index, n, 'Chapter ' || chapter_index || ': opens with ' || {_sql_clip('head')} || '. It develops across ' || n || ' paragraph(s) and closes with ' || {_sql_clip('tail')} ||
  '. Visible character/entity mentions: ' || CASE WHEN len(names) > 0 THEN array_to_string(names, ', ') ELSE 'none yet' END || '.' AS text FROM g""",
)
def chk_10(spark, sf_dir):
    return C.level2(C.level0(paragraphs(spark, sf_dir)))


@query(
    "chk_11_level3",
    f"""WITH {L0_CTE}, g AS (SELECT doc_id, count(DISTINCT chapter_index) AS chapters, list_sort(list(DISTINCT chapter_index)) AS cs, list_sort(list_distinct(flatten(list(names)))) AS names FROM l0 GROUP BY 1)
SELECT doc_id, chapters, 'Global index for ' || doc_id || '. Chapters=' || chapters || '. Chapter map: ' || array_to_string(list_transform(cs, lambda c: format('ch_{{:03d}}:Chapter {{}}', c, c)), ' | ') ||
  '. Known visible entities: ' || CASE WHEN len(names) > 0 THEN array_to_string(names, ', ') ELSE 'none detected' END || '. Designed for progress-aware retrieval and routing.' AS text FROM g""",
)
def chk_11(spark, sf_dir):
    return C.level3(C.level0(paragraphs(spark, sf_dir)))


@query(
    "chk_12_level4",
    f"""WITH {L0_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chapter_index ORDER BY CAST(list_contains(tags, 'dialogue') AS INT) DESC, {_R3.format('emotion + psychological')} DESC, length(text) DESC, paragraph_index) AS rank FROM l0)
SELECT doc_id, chapter_index, paragraph_index, rank FROM r WHERE rank <= 2""",
)
def chk_12(spark, sf_dir):
    return C.level4(C.level0(paragraphs(spark, sf_dir))).select("doc_id", "chapter_index", "paragraph_index", "rank")


@query(
    "chk_13_rehydrate",
    f"""WITH {L0_CTE}, t AS (SELECT doc_id, chapter_index, 'Title ' || min(paragraph_index) AS title FROM l0 WHERE chapter_index % 2 = 1 GROUP BY 1, 2)
SELECT l0.doc_id, l0.chapter_index, paragraph_index, coalesce(title, 'Chapter ' || l0.chapter_index) AS chapter_title, char_start FROM l0 LEFT JOIN t ON l0.doc_id = t.doc_id AND l0.chapter_index = t.chapter_index""",
)
def chk_13(spark, sf_dir):
    rows = C.level0(paragraphs(spark, sf_dir))
    titles = rows.where("chapter_index % 2 = 1").groupBy("doc_id", "chapter_index").agg(F.concat(F.lit("Title "), F.min("paragraph_index")).alias("title"))
    title = F.coalesce("title", F.concat(F.lit("Chapter "), "chapter_index"))
    return rows.join(titles, ["doc_id", "chapter_index"], "left").select("doc_id", "chapter_index", "paragraph_index", title.alias("chapter_title"), "char_start")


@query(
    "chk_14_dataset_manifest",
    f"""WITH {L0_CTE} SELECT 'l0' AS level, count(*) AS n FROM l0 UNION ALL
SELECT 'l1', count(*) FROM (SELECT DISTINCT doc_id, chapter_index, (row_number() OVER (PARTITION BY doc_id, chapter_index ORDER BY paragraph_index) - 1) // 2 FROM l0) UNION ALL
SELECT 'l2', count(*) FROM (SELECT DISTINCT doc_id, chapter_index FROM l0) UNION ALL SELECT 'l3', count(DISTINCT doc_id) FROM l0 UNION ALL
SELECT 'l4', count(*) FROM (SELECT 1 FROM l0 QUALIFY row_number() OVER (PARTITION BY doc_id, chapter_index ORDER BY paragraph_index) <= 2)""",
)
def chk_14(spark, sf_dir):
    rows = C.level0(paragraphs(spark, sf_dir))
    levels = {"l0": rows, "l1": C.level1(rows), "l2": C.level2(rows), "l3": C.level3(rows), "l4": C.level4(rows)}
    parts = [df.select(F.lit(name).alias("level"), "doc_id") for name, df in levels.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("level").agg(F.count("*").alias("n"))


def window_chunks(spark, sf_dir):
    rows = paragraphs(spark, sf_dir)
    return rows.select("doc_id", "chapter_index", "paragraph_index", T.token_count("text").cast("long").alias("tokens"), (T.is_heading("text") | T.is_scene_separator("text") | T.is_topic_shift("text")).alias("forced"))


@query("ext_01_windows")
def ext_01(spark, sf_dir):
    return C.extraction_windows(window_chunks(spark, sf_dir))


@query(
    "ext_02_lead_in",
    f"""WITH {P_CTE}, c AS (SELECT doc_id, chapter_index, paragraph_index, {_TOKENS} AS tokens, sum({_TOKENS}) OVER (PARTITION BY doc_id, chapter_index ORDER BY paragraph_index) AS th FROM p)
SELECT a.doc_id, a.chapter_index, a.paragraph_index, count(*) AS n_chunks, CAST(sum(b.tokens) AS BIGINT) AS n_tokens FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.chapter_index = b.chapter_index AND b.paragraph_index < a.paragraph_index AND a.th - a.tokens - b.th < 500 GROUP BY 1, 2, 3""",
)
def ext_02(spark, sf_dir):
    return C.lead_in(window_chunks(spark, sf_dir))


@query(
    "ext_03_window_extractions",
    f"""WITH {P_CTE}, w AS (SELECT doc_id, chapter_index, paragraph_index, row_number() OVER (PARTITION BY doc_id, chapter_index ORDER BY paragraph_index) AS i FROM p),
x AS (SELECT doc_id, chapter_index, i, unnest([(i + 1) // 2, (i - 1) // 2]) AS window_index FROM w)
SELECT doc_id, chapter_index, i, max(window_index) AS window_index FROM x WHERE window_index >= 1 GROUP BY 1, 2, 3""",
)
def ext_03(spark, sf_dir):
    """Windows of four chunks, each two on from the one before."""
    at = F.row_number().over(Window.partitionBy("doc_id", "chapter_index").orderBy("paragraph_index")).cast("long")
    rows = paragraphs(spark, sf_dir).withColumn("i", at)
    n = rows.groupBy("doc_id", "chapter_index").agg(F.max("i").alias("n_chunks"))
    starts = n.select("doc_id", "chapter_index", "n_chunks", F.explode(F.sequence(F.lit(1).cast("long"), "n_chunks", F.lit(2).cast("long"))).alias("start"))
    windows = starts.select("doc_id", "chapter_index", F.floor((F.col("start") + 1) / 2).alias("window_index"), "start", F.least(F.lit(4), F.col("n_chunks") - F.col("start") + 1).alias("n"))
    return C.spread_extractions(windows)


@query(
    "ext_04_known_entities",
    f"""WITH {M_CTE}, e AS (SELECT doc_id, lower(name) AS slug, count(*) AS mention_count, max((chapter_index, paragraph_index)) AS last_seen FROM m GROUP BY 1, 2),
r AS (SELECT doc_id, slug, mention_count, row_number() OVER (PARTITION BY doc_id ORDER BY mention_count DESC, slug) AS rank FROM e WHERE last_seen < (2, 12))
SELECT doc_id, slug, mention_count, rank FROM r WHERE rank <= 25""",
)
def ext_04(spark, sf_dir):
    from quillspark.operators import entities as E

    known = E.from_mentions(mentions(spark, sf_dir).withColumn("slug", F.lower("name")), ["doc_id"])
    before = known.where((F.col("last_seen.chapter_index") < 2) | ((F.col("last_seen.chapter_index") == 2) & (F.col("last_seen.paragraph_index") < 12)))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("mention_count"), "slug")).cast("long")
    return before.select("doc_id", "slug", "mention_count", rank.alias("rank")).where("rank <= 25")


_RAW = "CASE event_id % 3 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Sure: ' || props || ' done' ELSE props END"


@query("ext_06_json_salvage", f"SELECT event_id, CAST(json_extract_string(regexp_extract(raw, '(?s)\\{{.*\\}}', 0), '$.k') AS BIGINT) AS k FROM (SELECT event_id, {_RAW} AS raw FROM events)")
def ext_06(spark, sf_dir):
    raw = F.expr("CASE event_id % 3 WHEN 0 THEN '```json\n' || props || '\n```' WHEN 1 THEN 'Sure: ' || props || ' done' ELSE props END")
    bare = F.regexp_replace(F.trim(raw), r"^```[a-zA-Z]*\s*|\s*```$", "")
    found = F.coalesce(F.from_json(bare, "k bigint", {"mode": "PERMISSIVE"})["k"], F.from_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0), "k bigint")["k"])
    return table(spark, sf_dir, "events").select("event_id", found.alias("k"))


_TYPES = ("character", "location", "concept", "group", "theme", "artifact", "unknown")


@query(
    "ext_07_coerce_entities",
    f"""WITH {M_CTE} SELECT doc_id, paragraph_index, ord, trim(name) AS canonical_name, CASE WHEN ord % 4 = 0 THEN 'character' WHEN ord % 4 = 1 THEN 'location' ELSE 'unknown' END AS entity_type,
greatest(0.0, least(1.0, ord / 4)) AS confidence FROM m""",
)
def ext_07(spark, sf_dir):
    """Through JSON, as an extractor returns it: missing type, type in capitals, unknown type; confidence beyond 1."""
    kind = F.expr("CASE ord % 4 WHEN 0 THEN NULL WHEN 1 THEN 'LOCATION' ELSE 'robot' END")
    item = F.struct(F.concat(F.lit(" "), F.col("name")).alias("name"), kind.alias("type"), (F.col("ord") / 4).cast("string").alias("confidence"))
    raw = mentions(spark, sf_dir).select("doc_id", "paragraph_index", "ord", F.to_json(F.array(item)).alias("raw"))
    rows = raw.select("doc_id", "paragraph_index", "ord", F.inline(F.from_json("raw", "array<struct<canonical_name:string,name:string,type:string,confidence:string>>")))
    low = F.lower(F.trim("type"))
    return rows.select(
        "doc_id",
        "paragraph_index",
        "ord",
        F.trim(F.coalesce("canonical_name", "name")).alias("canonical_name"),
        F.when(F.col("type").isNull(), "character").when(low.isin(*_TYPES), low).otherwise("unknown").alias("entity_type"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.expr("try_cast(confidence as double)"), F.lit(0.0)))).alias("confidence"),
    )


@query(
    "ext_08_coerce_facts",
    f"""WITH {M_CTE}, fp AS (SELECT doc_id, paragraph_index, min_by(name, ord) AS a, max_by(name, ord) AS b, count(*) AS n FROM m GROUP BY 1, 2)
SELECT doc_id, paragraph_index, a AS source, b AS target, 'SPOKE_WITH' AS relation_type, CASE WHEN n % 2 = 0 THEN 'interaction' ELSE 'context' END AS state_family, 'undirected' AS directionality FROM fp WHERE n > 1""",
)
def ext_08(spark, sf_dir):
    m = mentions(spark, sf_dir).groupBy("doc_id", "paragraph_index").agg(F.min_by("name", "ord").alias("a"), F.max_by("name", "ord").alias("b"), F.count("*").alias("n"))
    fact = F.struct(F.col("a").alias("source"), F.when(F.col("n") > 1, F.col("b")).alias("target"), F.lit("spoke_with").alias("relation_type"), F.when(F.col("n") % 2 == 0, "interaction").otherwise("nonsense").alias("state_family"), F.lit("sideways").alias("directionality"), F.lit("x").alias("fact"))
    raw = m.select("doc_id", "paragraph_index", F.to_json(F.array(fact)).alias("raw"))
    rows = raw.select("doc_id", "paragraph_index", F.inline(F.from_json("raw", "array<struct<source:string,target:string,relation_type:string,state_family:string,directionality:string,fact:string>>")))
    families = ("identity", "location", "membership", "status", "interaction", "sentiment", "context")
    full = rows.where("source is not null and target is not null and relation_type is not null and fact is not null")
    return full.select(
        "doc_id", "paragraph_index", "source", "target", F.upper("relation_type").alias("relation_type"),
        F.when(F.col("state_family").isin(*families), F.col("state_family")).otherwise("context").alias("state_family"),
        F.when(F.col("directionality").isin("directed", "undirected"), F.col("directionality")).otherwise("undirected").alias("directionality"),
    )


@query("ext_11_surface_names")
def ext_11(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("doc_id", "paragraph_index", F.array_join(T.surface_names("text"), "|").alias("names"))


_PARENTS = "SELECT DISTINCT p_partkey // 4 AS parent, p_partkey AS child FROM part UNION SELECT DISTINCT p_partkey // 4 + p_size % 3, p_partkey FROM part WHERE p_partkey >= 8"


@query(
    "ext_12_generations",
    f"""WITH RECURSIVE par AS ({_PARENTS}),
walk(node, generation) AS (SELECT DISTINCT parent, 0 FROM par WHERE parent NOT IN (SELECT child FROM par)
  UNION SELECT child, generation + 1 FROM walk JOIN par ON parent = node WHERE generation < 50)
SELECT CAST(node AS BIGINT) AS node, CAST(min(generation) AS BIGINT) AS generation FROM walk GROUP BY node""",
)
def ext_12(spark, sf_dir):
    """Every part descends from the part of a quarter of its number, those from 8 on also from one of the two after that."""
    part = table(spark, sf_dir, "part")
    quarter = F.floor(F.col("p_partkey") / 4)
    second = part.where("p_partkey >= 8").select((quarter + F.col("p_size") % 3).alias("parent"), F.col("p_partkey").alias("child"))
    return G.generations(spark, part.select(quarter.alias("parent"), F.col("p_partkey").alias("child")).union(second))
