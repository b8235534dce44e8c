"""Memory layer (MEM), analytics (ANA) and view transforms (UI) over the documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import graph as G
from quillspark.operators import memory as M
from quillspark.operators import relations as Rel
from quillspark.plans.graphs import _REL, EN_CTE, TE_CTE, entities, slugged, text_edges, text_relations
from quillspark.plans.registry import query
from quillspark.plans.relations import ED_CTE, star_relations
from quillspark.plans.views import M_CTE, P_CTE, paragraphs, table

_R3 = "floor(({}) * 1000 + 0.5) / 1000"


def _texts(spark, sf_dir):
    return paragraphs(spark, sf_dir, by_book=True).select("doc_id", "paragraph_index", "text")


_SPANS = "string_agg(s.paragraph_index || ':' || s.pos, ',' ORDER BY s.paragraph_index, s.ord)"
_REG = f"""{M_CTE}, s0 AS (SELECT m.doc_id, lower(name) AS slug, m.paragraph_index, ord, instr(text, name) - 1 AS pos FROM m JOIN p ON p.doc_id = m.doc_id AND p.paragraph_index = m.paragraph_index),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY paragraph_index, ord) AS k, count(*) OVER (PARTITION BY doc_id, slug) AS n FROM s0)"""


def _registry(spark, sf_dir, most):
    r = M.registry(slugged(spark, sf_dir).drop("chapter_index"), _texts(spark, sf_dir), most)
    return r.select("doc_id", "slug", "n_mentions", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["paragraph_index"], s["at"])), ",").alias("spans"))


@query("mem_01_registry", f"WITH {_REG} SELECT doc_id, slug, max(n) AS n_mentions, {_SPANS} AS spans FROM s WHERE k <= 80 GROUP BY 1, 2")
def mem_01(spark, sf_dir):
    return _registry(spark, sf_dir, 80)


@query("mem_02_heuristic_registry", f"WITH {_REG} SELECT doc_id, slug, max(n) AS n_mentions, {_SPANS} AS spans, 0.35::DOUBLE AS confidence FROM s WHERE k <= 5 GROUP BY 1, 2")
def mem_02(spark, sf_dir):
    return _registry(spark, sf_dir, 5).withColumn("confidence", F.lit(0.35))


def _sql_clip(x, n):
    c = rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE left({c}, {n - 1}) || '…' END"


# Driver texts have no CJK; vowels stand for characters of a small alphabet.
_ALPHABET = ("aeioudnst", "山水人心月火木石云")
_ZH = f"translate(regexp_replace(lower(text), '[^aeioudnst ]', '', 'g'), '{_ALPHABET[0]}', '{_ALPHABET[1]}')"


def _cjk(spark, sf_dir):
    bare = F.regexp_replace(F.lower("text"), "[^aeioudnst ]", "")
    return paragraphs(spark, sf_dir, by_book=True).select("doc_id", F.col("paragraph_index").alias("ord"), F.translate(bare, *_ALPHABET).alias("text"))


_ZT = f"zt AS (SELECT doc_id, paragraph_index AS ord, {_ZH} AS text FROM p)"


@query("mem_04_theme_terms", f"""WITH {P_CTE}, {_ZT}, r AS (SELECT doc_id, ord, unnest(ts) AS term, unnest(range(0, len(ts))) AS pos FROM (SELECT doc_id, ord, regexp_extract_all(text, '[一-鿿]{{2,4}}') AS ts FROM zt)),
g AS (SELECT doc_id, term, count(*) AS n, min((ord, pos)) AS f FROM r WHERE term NOT IN ('我们', '他们', '这个', '那个', '自己', '因为', '所以', '但是', '没有', '一个') GROUP BY 1, 2)
SELECT doc_id, term, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rank FROM g QUALIFY rank <= 12""")
def mem_04(spark, sf_dir):
    return M.theme_terms(_cjk(spark, sf_dir))


_MARKERS = ["the", "la", "der", "que", "und", "of"]
_SAL = f"floor(least(1.0::DOUBLE, 0.15::DOUBLE * ({' + '.join(f'CASE WHEN contains(text, {chr(39)}{m}{chr(39)}) THEN 1 ELSE 0 END' for m in _MARKERS)}) + least(length(text) / 800, 0.4::DOUBLE)) * 1000 + 0.5) / 1000"
#: The four layers as common table expressions; me has them all.
_ME = f"""{TE_CTE}, {_ZT}, sa AS (SELECT *, {_SAL} AS salience FROM p),
oc AS (SELECT doc_id, paragraph_index, list_sort(list(DISTINCT lower(name))) AS ids FROM m GROUP BY 1, 2),
orl AS (SELECT doc_id, valid_at AS paragraph_index, list_sort(list(DISTINCT source || '|' || target)) AS rels FROM te GROUP BY 1, 2),
m1_ AS (SELECT sa.doc_id, 'episode::' || sa.paragraph_index AS memory_id, 'episode' AS memory_type, 'Chapter ' || chapter_index || ' paragraph ' || sa.paragraph_index AS title, {_sql_clip('text', 220)} AS summary, chapter_index, sa.paragraph_index,
  coalesce(ids, []) AS entity_ids, coalesce(rels, []) AS relation_ids, [sa.paragraph_index::VARCHAR] AS evidence, salience FROM sa LEFT JOIN oc ON oc.doc_id = sa.doc_id AND oc.paragraph_index = sa.paragraph_index LEFT JOIN orl ON orl.doc_id = sa.doc_id AND orl.paragraph_index = sa.paragraph_index),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chapter_index ORDER BY paragraph_index) AS k FROM sa),
hh AS (SELECT doc_id, chapter_index, {_sql_clip("string_agg(text, ' ' ORDER BY paragraph_index) FILTER (k <= 8)", 360)} AS summary, list(paragraph_index::VARCHAR ORDER BY paragraph_index) FILTER (k <= 8) AS evidence, max(salience) AS salience FROM h GROUP BY 1, 2),
ls AS (SELECT hh.doc_id, hh.chapter_index, list_sort(list(DISTINCT slug))[1:18] AS ids FROM hh JOIN ent ON ent.doc_id = hh.doc_id AND hh.chapter_index BETWEEN first_chapter AND last_chapter GROUP BY 1, 2),
m2_ AS (SELECT hh.doc_id, 'chapter::' || lpad(hh.chapter_index::VARCHAR, 3, '0'), 'chapter', 'Chapter ' || hh.chapter_index, summary, hh.chapter_index, NULL, coalesce(ids, []), [], evidence, salience FROM hh LEFT JOIN ls ON ls.doc_id = hh.doc_id AND ls.chapter_index = hh.chapter_index),
pl AS (SELECT doc_id, lower(name) AS slug, list(paragraph_index::VARCHAR ORDER BY paragraph_index, ord)[1:10] AS ps FROM m GROUP BY 1, 2),
m3_ AS (SELECT ent.doc_id, 'character::' || ent.slug, 'character_arc', name, name || ' appears from chapter ' || first_chapter || '.', last_chapter, last_paragraph, [ent.slug], [], ps, floor(least(1.0::DOUBLE, 0.25::DOUBLE + mention_count / 20) * 1000 + 0.5) / 1000 FROM ent JOIN pl ON pl.doc_id = ent.doc_id AND pl.slug = ent.slug WHERE type = 'character'),
tr AS (SELECT doc_id, ord, unnest(ts) AS term, unnest(range(0, len(ts))) AS pos FROM (SELECT doc_id, ord, regexp_extract_all(text, '[一-鿿]{{2,4}}') AS ts FROM zt)),
tg AS (SELECT doc_id, term, count(*) AS n, min((ord, pos)) AS f FROM tr WHERE term NOT IN ('我们', '他们', '这个', '那个', '自己', '因为', '所以', '但是', '没有', '一个') GROUP BY 1, 2),
tt AS (SELECT doc_id, term, n FROM tg QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) <= 8),
m4_ AS (SELECT tt.doc_id, 'theme::' || term, 'theme_arc', term, '主题词“' || term || '”在当前文本中出现 ' || any_value(n) || ' 次，可作为阅读线索。', 1, NULL, [], [], (list(ord ORDER BY ord)[1:8])::VARCHAR[], floor(least(1.0::DOUBLE, any_value(n) / 20) * 1000 + 0.5) / 1000 FROM tt JOIN zt ON zt.doc_id = tt.doc_id AND contains(zt.text, term) GROUP BY tt.doc_id, term),
me AS (SELECT * FROM m1_ UNION ALL SELECT * FROM m2_ UNION ALL SELECT * FROM m3_ UNION ALL SELECT * FROM m4_)"""


def layers(spark, sf_dir, found):
    zh = _cjk(spark, sf_dir)
    texts = zh.select("doc_id", F.col("ord").alias("paragraph_index"), "text")
    return M.layered_memories(paragraphs(spark, sf_dir, by_book=True), found, entities(spark, sf_dir, found), text_edges(spark, sf_dir, found), M.theme_terms(zh), texts, _MARKERS)


def _lists(df):
    return df.withColumns({c: F.array_join(c, ",") for c in ("entity_ids", "relation_ids", "evidence")})


@query("mem_03_layered_memories", f"WITH {_ME} SELECT * REPLACE (array_to_string(entity_ids, ',') AS entity_ids, array_to_string(relation_ids, ',') AS relation_ids, array_to_string(evidence, ',') AS evidence) FROM me")
def mem_03(spark, sf_dir):
    return _lists(layers(spark, sf_dir, slugged(spark, sf_dir)))


@query("mem_05_retrieval_documents", f"""WITH {_ME} SELECT doc_id, 'chunk::p' || paragraph_index AS document_id, 'book_text' AS source_type, chapter_index, paragraph_index, text FROM p UNION ALL
SELECT doc_id, 'entity::' || slug, 'entity', first_chapter, first_paragraph, name || ' x' || slug || ' ' || upper(slug) || ' ' || type FROM ent UNION ALL
SELECT doc_id, 'relation::' || source || '|' || target, 'relation', (valid_at - 1) // 8 + 1, valid_at, source || ' SPOKE_WITH ' || target FROM te UNION ALL
SELECT doc_id, memory_id, 'memory_' || memory_type, chapter_index, paragraph_index, title || chr(10) || summary FROM me""")
def mem_05(spark, sf_dir):
    found = slugged(spark, sf_dir)
    ents = entities(spark, sf_dir, found).withColumn("aliases", F.array(F.concat(F.lit("x"), "slug"), F.upper("slug"))).withColumn("summary", F.col("type"))
    rel = text_edges(spark, sf_dir, found).selectExpr("doc_id", "source", "target", "concat(source, ' SPOKE_WITH ', target) as fact", "floor((valid_at - 1) / 8) + 1 as valid_chapter", "valid_at as valid_paragraph")
    return M.retrieval_documents(paragraphs(spark, sf_dir, by_book=True), ents, rel, layers(spark, sf_dir, found))


_EMBEDDING = "CASE WHEN doc_id % 4 = 0 THEN 'none' WHEN doc_id % 4 = 1 THEN 'no_endpoint' WHEN doc_id % 8 = 2 THEN 'failed: timeout' ELSE 'ready' END"


@query("mem_06_index_status", f"""WITH {EN_CTE}, b AS (SELECT d.doc_id, doc_id % 7 <> 3 AS has_graph, {_EMBEDDING} AS e, (SELECT count(*) FROM ent WHERE ent.doc_id = d.doc_id) AS n FROM documents d),
r AS (SELECT doc_id, list_filter([CASE WHEN NOT has_graph THEN 'graph_missing' END, CASE WHEN e = 'none' THEN '{M.NO_EMBEDDING}' WHEN e = 'no_endpoint' THEN '{M.NO_ENDPOINT}' WHEN e = 'failed: timeout' THEN 'embedding API failed: timeout' END,
  CASE WHEN NOT has_graph OR n = 0 THEN '{M.NO_ENTITIES}' END], lambda x: x IS NOT NULL) AS rs FROM b)
SELECT doc_id, CASE WHEN len(rs) > 0 THEN 'degraded' ELSE 'ready' END AS status, array_to_string(rs, ',') AS reasons FROM r""")
def mem_06(spark, sf_dir):
    """Every seventh book has no graph, and three of four no embeddings for one reason or other."""
    n = entities(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_entities"))
    books = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 7 != 3).alias("has_graph"), F.expr(_EMBEDDING).alias("embedding")).join(n, "doc_id", "left")
    return M.index_status(books).withColumn("reasons", F.array_join("reasons", ","))


@query("mem_07_audit", f"""WITH {TE_CTE}, k AS (SELECT * FROM ent WHERE mention_count > 1) SELECT 'duplicate' AS issue, slug AS key, count(*) AS n FROM ent GROUP BY 2 HAVING count(*) > 1 UNION ALL
SELECT 'dangling', CAST(doc_id AS VARCHAR), count(*) FROM te WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = te.doc_id AND slug = source) OR NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = te.doc_id AND slug = target) GROUP BY 2""")
def mem_07(spark, sf_dir):
    ents = entities(spark, sf_dir)
    duplicate = ents.groupBy(F.col("slug").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("issue"), "key", "n")
    loose = M.dangling(text_edges(spark, sf_dir), ents.where("mention_count > 1")).groupBy(F.col("doc_id").cast("string").alias("key")).agg(F.count("*").alias("n"))
    return duplicate.unionByName(loose.select(F.lit("dangling").alias("issue"), "key", "n"))


@query("mem_08_entity_list", f"WITH {EN_CTE} SELECT doc_id, slug, mention_count, last_chapter, row_number() OVER (PARTITION BY doc_id ORDER BY mention_count DESC, last_chapter DESC, slug) AS rank FROM ent WHERE type = 'character' AND first_chapter <= 3 AND (contains(lower(name || ' al-' || slug || ' seen ' || mention_count), 'er') OR contains(lower(name || ' al-' || slug || ' seen ' || mention_count), 'seen 2'))")
def mem_08(spark, sf_dir):
    e = entities(spark, sf_dir).withColumn("aliases", F.array(F.concat(F.lit("Al-"), "slug"))).withColumn("summary", F.concat(F.lit("Seen "), F.col("mention_count").cast("string")))
    return M.entity_list(e, ["er", "seen 2"], "character", 3).select("doc_id", "slug", "mention_count", "last_chapter", "rank")


@query("mem_09_entity_detail", f"""WITH {_ME}, re AS (SELECT *, {_REL} FROM te), w AS (SELECT doc_id, slug FROM ent WHERE type = 'character' AND mention_count > 1),
r AS (SELECT re.*, w.slug FROM re JOIN w ON w.doc_id = re.doc_id AND (w.slug = source OR w.slug = target))
SELECT r.doc_id, r.slug, 'relation' AS kind, source || '|' || target AS key, coalesce(a.name, source) || ' ' || relation_type || ' ' || coalesce(b.name, target) || ' ' || status || ' p' || valid_at AS text
FROM r LEFT JOIN ent a ON a.doc_id = r.doc_id AND a.slug = source LEFT JOIN ent b ON b.doc_id = r.doc_id AND b.slug = target
UNION ALL SELECT me.doc_id, w.slug, 'memory', memory_id, summary FROM me JOIN w ON w.doc_id = me.doc_id AND list_contains(entity_ids, w.slug) WHERE memory_type = 'character_arc'""")
def mem_09(spark, sf_dir):
    """The details of all characters mentioned more than once."""
    found = slugged(spark, sf_dir)
    ents = entities(spark, sf_dir, found)
    wanted = ents.where("type = 'character' and mention_count > 1").select("doc_id", "slug")
    rel = text_relations(spark, sf_dir, found).withColumn("valid_paragraph", F.col("valid_at"))
    return M.entity_detail(wanted, ents, rel, layers(spark, sf_dir, found))


def _sql_map(scope, chapter, paragraph, limit):
    """The map of one scope, written from its rules: nd nodes, eg edges, cd cards."""
    pool = {"chapter": f"first_chapter <= {chapter} AND last_chapter >= {chapter}", "passage": f"first_chapter <= {chapter} AND (first_chapter < {chapter} OR first_paragraph <= {paragraph})", "book": f"first_chapter <= {chapter}"}.get(scope)
    seen = f"sv AS (SELECT *, (valid_at - 1) // 8 + 1 AS vc FROM te WHERE (valid_at - 1) // 8 + 1 <= {chapter})"
    seed = "sd AS (SELECT doc_id, arg_max(slug, (mention_count, slug)) AS slug FROM ent WHERE type = 'character' GROUP BY 1)"
    if scope == "character":
        nodes = f"""ne AS (SELECT DISTINCT sv.doc_id, CASE WHEN source = slug THEN target ELSE source END AS slug FROM sv JOIN sd ON sd.doc_id = sv.doc_id AND (source = slug OR target = slug) WHERE source <> target),
nr AS (SELECT ne.doc_id, ne.slug, mention_count FROM ne JOIN ent ON ent.doc_id = ne.doc_id AND ent.slug = ne.slug QUALIFY row_number() OVER (PARTITION BY ne.doc_id ORDER BY mention_count DESC, ne.slug) <= {limit - 1}),
n0 AS (SELECT * FROM nr UNION ALL SELECT sd.doc_id, sd.slug, mention_count FROM sd JOIN ent ON ent.doc_id = sd.doc_id AND ent.slug = sd.slug)"""
    else:
        nodes = f"n0 AS (SELECT doc_id, slug, mention_count FROM ent WHERE {pool} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY mention_count DESC, slug) <= {limit})"
    gate = f"(vc < {chapter} OR valid_at <= {paragraph})" if paragraph else "true"
    kinds = {"chapter": "memory_type IN ('chapter', 'theme_arc', 'character_arc')", "passage": "memory_type IN ('episode', 'chapter')"}.get(scope, "true")
    own = "EXISTS (SELECT 1 FROM sd WHERE sd.doc_id = me.doc_id AND list_contains(entity_ids, sd.slug))" if scope == "character" else f"chapter_index <= {chapter}"
    return f"""{seen}, {seed}, {nodes},
nd AS (SELECT doc_id, 'node' AS kind, slug AS key, mention_count::DOUBLE AS value, row_number() OVER (PARTITION BY doc_id ORDER BY mention_count DESC, slug) AS place FROM n0),
eg AS (SELECT doc_id, 'edge', source || '|' || target, weight::DOUBLE, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, source, target) AS place FROM sv WHERE {gate}
  AND EXISTS (SELECT 1 FROM n0 WHERE n0.doc_id = sv.doc_id AND slug = source) AND EXISTS (SELECT 1 FROM n0 WHERE n0.doc_id = sv.doc_id AND slug = target) QUALIFY place <= {max(limit + 6, 12)}),
cd AS (SELECT doc_id, 'card', memory_id, salience, row_number() OVER (PARTITION BY doc_id ORDER BY salience DESC, memory_id) AS place FROM me WHERE {kinds} AND {own} QUALIFY place <= 8)
SELECT * FROM nd UNION ALL SELECT * FROM eg UNION ALL SELECT * FROM cd"""


def _map(scope, chapter, paragraph, limit):
    def run(spark, sf_dir):
        found = slugged(spark, sf_dir)
        ents = entities(spark, sf_dir, found)
        seeds = None
        if scope == "character":
            seeds = ents.where("type = 'character'").groupBy("doc_id").agg(F.max_by("slug", F.struct("mention_count", "slug")).alias("slug"))
        edges = text_edges(spark, sf_dir, found).withColumn("valid_chapter", F.floor((F.col("valid_at") - 1) / 8) + 1).withColumn("valid_paragraph", F.col("valid_at"))
        nodes, links, cards = M.memory_map(ents, edges, layers(spark, sf_dir, found), scope, chapter, paragraph, seeds, limit)
        rows = lambda df, kind, key, value: df.select("doc_id", F.lit(kind).alias("kind"), key.alias("key"), F.col(value).cast("double").alias("value"), "place")
        return rows(nodes, "node", F.col("slug"), "mention_count").unionByName(rows(links, "edge", F.concat_ws("|", "source", "target"), "weight")).unionByName(rows(cards, "card", F.col("memory_id"), "salience"))

    return run


for _name, _scope, _args in (("mem_10_memory_map", "chapter", (2, 0, 6)), ("mem_10_map_passage", "passage", (2, 12, 8)), ("mem_10_map_character", "character", (3, 0, 5)), ("mem_10_map_book", "book", (4, 0, 18))):
    query(_name, f"WITH {_ME}, {_sql_map(_scope, *_args)}")(_map(_scope, *_args))


@query("ana_01_wordcloud", f"WITH {EN_CTE} SELECT doc_id, name, mention_count FROM ent WHERE type IN ('character', 'location') AND lower(name) NOT IN ('the', 'and', 'for', 'with', 'that') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY mention_count DESC, name) <= 8")
def ana_01(spark, sf_dir):
    e = entities(spark, sf_dir).where("type in ('character', 'location')").where(~F.lower("name").isin("the", "and", "for", "with", "that"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("mention_count"), "name"))
    return e.withColumn("k", rank).where("k <= 8").select("doc_id", "name", "mention_count")


@query("ana_02_frequent_ngrams", f"""WITH {P_CTE}, {_ZT}, r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[一-鿿]{{2,80}}')) AS run FROM zt), n AS (SELECT doc_id, run, unnest([2, 3, 4]) AS n FROM r),
g AS (SELECT doc_id, substring(run, i, n) AS token, n FROM (SELECT doc_id, run, n, unnest(range(1, length(run) - n + 2)) AS i FROM n WHERE length(run) >= n)),
w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]{{2,}}'))) AS token FROM p),
u AS (SELECT doc_id, token, 1 + (n - 2) * 0.18::DOUBLE AS weight FROM g WHERE NOT regexp_matches(token, '[{M.BLOCKED_CHARS}]') UNION ALL SELECT doc_id, token, 1.0::DOUBLE FROM w)
SELECT doc_id, token, {_R3.format('sum(weight)')} AS weight FROM u GROUP BY 1, 2""")
def ana_02(spark, sf_dir):
    bare = F.translate(F.regexp_replace(F.lower("text"), "[^aeioudnst ]", ""), *_ALPHABET)
    g = M.frequent_ngrams(paragraphs(spark, sf_dir).select("doc_id", F.concat_ws("\n", bare, "text").alias("text")))
    return g.select("doc_id", "token", T.round3(F.col("weight")).alias("weight"))


_STYLE, _WEAK, _JUDGE = ["time", "war", "hope", "tion", "ness"], ["the", "what", "that"], ["seem", "at last", "erst"]


def _has(words):
    return " + ".join(f"CASE WHEN contains(s, '{w}') THEN 1 ELSE 0 END" for w in words)


_SIG = f"""{M_CTE}, nn AS (SELECT doc_id, paragraph_index, count(*) AS g FROM m GROUP BY 1, 2),
se AS (SELECT doc_id, chapter_index, paragraph_index, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT *, list_filter(list_transform(regexp_extract_all(text, '[^.！？!?]*[.！？!?]|[^.！？!?]+$'), lambda x: trim(x)), lambda x: x <> '') AS ss FROM p)),
di AS (SELECT * FROM se QUALIFY row_number() OVER (PARTITION BY doc_id, s ORDER BY paragraph_index, i) = 1),
sc AS (SELECT di.doc_id, di.paragraph_index, i, s, {_R3.format(f"CASE WHEN length(s) < 10 OR length(s) > 92 THEN -20.0::DOUBLE ELSE (1.0::DOUBLE - least(abs(length(s) - 34) / 58, 1.0::DOUBLE)) * 2.0::DOUBLE + ({_has(_STYLE)}) * 1.35::DOUBLE - ({_has(_WEAK)}) * 0.42::DOUBLE + 0.0::DOUBLE + least(coalesce(g, 0), 8) * 0.22::DOUBLE + CASE WHEN regexp_matches(s, '{'|'.join(_JUDGE)}') THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN regexp_matches(s, '[，；,;]') THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END + 0.16::DOUBLE / greatest(chapter_index, 1) + 0.06::DOUBLE / greatest(di.paragraph_index, 1) END")} AS score
  FROM di LEFT JOIN nn ON nn.doc_id = di.doc_id AND nn.paragraph_index = di.paragraph_index)"""


def signature_sentences(spark, sf_dir):
    parts = F.filter(F.transform(F.split("text", r"(?<=[.！？!?])"), lambda x: F.trim(x)), lambda x: x != "")
    rows = paragraphs(spark, sf_dir).select("doc_id", "chapter_index", "paragraph_index", F.posexplode(parts).alias("i", "s"))
    first = F.row_number().over(Window.partitionBy("doc_id", "s").orderBy("paragraph_index", "i"))
    graph = slugged(spark, sf_dir).groupBy("doc_id", "paragraph_index").agg(F.count("*").alias("g"))
    rows = rows.withColumn("k", first).where("k = 1").join(graph, ["doc_id", "paragraph_index"], "left")
    score = M.signature_score(F.col("s"), _STYLE, _WEAK, _JUDGE, F.col("chapter_index"), F.col("paragraph_index"), F.lit(0.0), F.coalesce("g", F.lit(0)))
    return rows.select("doc_id", "paragraph_index", (F.col("i") + 1).cast("long").alias("i"), F.col("s").alias("sentence"), T.round3(score).alias("score"))


@query("scr_11_signature_score", f"WITH {_SIG} SELECT doc_id, paragraph_index, i, s AS sentence, score FROM sc")
def scr_11(spark, sf_dir):
    return signature_sentences(spark, sf_dir)


@query("ana_03_signature_lines", f"WITH {_SIG} SELECT doc_id, s AS sentence, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, paragraph_index, i) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 3")
def ana_03(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "paragraph_index", "i")).cast("long")
    return signature_sentences(spark, sf_dir).where("score > 0").withColumn("rank", rank).where("rank <= 3").select("doc_id", "sentence", "score", "rank")


def _sql_view(chapter, paragraph, limit, from_chapter, min_weight, max_edges):
    gate = "true" if chapter is None else f"first_chapter <= {chapter}" if paragraph is None else f"(first_chapter < {chapter} OR (first_chapter = {chapter} AND first_paragraph <= {paragraph}))"
    rgate = gate.replace("first_chapter", "vc").replace("first_paragraph", "valid_at")
    inside = "true" if chapter is None else f"list_contains(chapters, {chapter})"
    listed = "true" if chapter is None else f"vc = {chapter}"
    edges = f"ef AS (SELECT * FROM e1 WHERE weight >= {min_weight} {f'QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, source, target) <= {max_edges}' if max_edges else ''})"
    return f"""WITH {TE_CTE}, rv AS (SELECT *, (valid_at - 1) // 8 + 1 AS vc FROM te), sh AS (SELECT * FROM rv WHERE {rgate} AND {listed} AND vc >= {from_chapter}),
po AS (SELECT doc_id, slug FROM ent WHERE {gate} AND {inside} AND last_chapter >= {from_chapter} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY mention_count DESC, slug) <= {max(6, limit)}),
ch AS (SELECT DISTINCT doc_id, slug FROM (SELECT * FROM po UNION ALL SELECT doc_id, source FROM sh UNION ALL SELECT doc_id, target FROM sh)),
nd AS (SELECT ch.doc_id, ch.slug, mention_count FROM ch JOIN ent ON ent.doc_id = ch.doc_id AND ent.slug = ch.slug QUALIFY row_number() OVER (PARTITION BY ch.doc_id ORDER BY mention_count DESC, ch.slug) <= {limit}),
e1 AS (SELECT * FROM sh WHERE EXISTS (SELECT 1 FROM nd WHERE nd.doc_id = sh.doc_id AND slug = source) AND EXISTS (SELECT 1 FROM nd WHERE nd.doc_id = sh.doc_id AND slug = target)), {edges}
SELECT doc_id, 'node' AS kind, slug AS key, mention_count AS n FROM nd UNION ALL SELECT doc_id, 'edge', source || '|' || target, weight FROM ef"""


def _view(chapter, paragraph, limit, from_chapter, min_weight, max_edges):
    def run(spark, sf_dir):
        found = slugged(spark, sf_dir)
        at = F.floor((F.col("valid_at") - 1) / 8) + 1
        rel = text_edges(spark, sf_dir, found).withColumn("valid_chapter", at).withColumn("valid_paragraph", F.col("valid_at")).withColumn("chapter_index", at)
        nodes, edges = G.view(entities(spark, sf_dir, found), rel, chapter, paragraph, limit, from_chapter, min_weight, max_edges)
        a = nodes.select("doc_id", F.lit("node").alias("kind"), F.col("slug").alias("key"), F.col("mention_count").alias("n"))
        return a.unionByName(edges.select("doc_id", F.lit("edge").alias("kind"), F.concat_ws("|", "source", "target").alias("key"), F.col("weight").alias("n")))

    return run


for _name, _args in (("ana_04_graph_view", (2, None, 6, 0, 0, 0)), ("ana_04_view_paragraph", (2, 12, 8, 1, 0, 5)), ("ana_04_view_book", (None, None, 10, 2, 2, 12))):
    query(_name, _sql_view(*_args))(_view(*_args))


@query("ana_05_graph_heads", f"WITH {ED_CTE} SELECT signature, weight, valid_at FROM sup ORDER BY f, signature LIMIT 100")
def ana_05(spark, sf_dir):
    return star_relations(spark, sf_dir).orderBy("first", "signature").limit(100).select("signature", "weight", "valid_at")


@query("ana_06_audit_chain", f"""WITH {ED_CTE}, h AS (SELECT source, target, signature, valid_at, row_number() OVER (PARTITION BY source ORDER BY f) AS step, lag(signature) OVER (PARTITION BY source ORDER BY f) AS supersedes FROM sup)
SELECT source, step, signature, supersedes, valid_at FROM h""")
def ana_06(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("first")
    rel = star_relations(spark, sf_dir)
    return rel.select("source", F.row_number().over(w).cast("long").alias("step"), "signature", F.lag("signature").over(w).alias("supersedes"), "valid_at")


@query("ana_07_graph_query_defaults", f"WITH {P_CTE} SELECT doc_id, 'chapter' AS hit_type, 'c' || chapter_index AS hit_id FROM p WHERE chapter_index <= 2 GROUP BY ALL UNION ALL SELECT doc_id, 'episode', 'e' || paragraph_index FROM p WHERE chapter_index <= 2")
def ana_07(spark, sf_dir):
    """An empty query without node types asks for chapters and episodes."""
    p = paragraphs(spark, sf_dir).where("chapter_index <= 2")
    chapters = p.select("doc_id", F.lit("chapter").alias("hit_type"), F.concat(F.lit("c"), "chapter_index").alias("hit_id")).distinct()
    return chapters.union(p.select("doc_id", F.lit("episode"), F.concat(F.lit("e"), "paragraph_index")))


@query("ana_08_character_candidates", f"WITH {EN_CTE} SELECT slug, doc_id, mention_count FROM ent WHERE type = 'character' AND first_chapter <= 2 QUALIFY row_number() OVER (PARTITION BY slug ORDER BY mention_count DESC, doc_id) = 1")
def ana_08(spark, sf_dir):
    e = entities(spark, sf_dir).where("type = 'character' and first_chapter <= 2")
    best = e.groupBy("slug").agg(F.max(F.struct("mention_count", (-F.col("doc_id")).alias("d"))).alias("x"))
    return best.select("slug", (-F.col("x.d")).alias("doc_id"), "x.mention_count")


@query("ana_09_book_detail", f"WITH {P_CTE} SELECT doc_id, chapter_index, min_by('Title ' || paragraph_index, paragraph_index) FILTER (paragraph_index % 3 = 0) AS title, string_agg(text, '|' ORDER BY paragraph_index) AS paragraphs FROM p GROUP BY 1, 2")
def ana_09(spark, sf_dir):
    title = F.min_by(F.when(F.col("paragraph_index") % 3 == 0, F.concat(F.lit("Title "), "paragraph_index")), F.when(F.col("paragraph_index") % 3 == 0, F.col("paragraph_index")))
    heads = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_index", F.col("text").alias("h")))), lambda x: x["h"]), "|")
    return paragraphs(spark, sf_dir).groupBy("doc_id", "chapter_index").agg(title.alias("title"), heads.alias("paragraphs"))


@query("ana_10_character_block", f"""WITH {TE_CTE}, g AS (SELECT doc_id, source, CASE WHEN weight > 2 THEN 'family' WHEN weight = 2 THEN 'interaction' ELSE 'other' END AS kind, target, weight FROM te),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, kind ORDER BY weight DESC, target) AS k FROM g)
SELECT doc_id, source, kind, string_agg(target, ',' ORDER BY k) AS targets FROM r WHERE k <= CASE kind WHEN 'interaction' THEN 12 WHEN 'other' THEN 5 ELSE 8 END GROUP BY 1, 2, 3""")
def ana_10(spark, sf_dir):
    kind = F.when(F.col("weight") > 2, "family").when(F.col("weight") == 2, "interaction").otherwise("other")
    g = text_edges(spark, sf_dir).withColumn("kind", kind)
    k = F.row_number().over(Window.partitionBy("doc_id", "source", "kind").orderBy(F.desc("weight"), "target"))
    most = F.when(F.col("kind") == "interaction", 12).when(F.col("kind") == "other", 5).otherwise(8)
    kept = g.withColumn("k", k).where(F.col("k") <= most)
    return kept.groupBy("doc_id", "source", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "target"))), lambda x: x["target"]), ",").alias("targets"))


_UI = "CASE " + " ".join(f"WHEN regexp_matches(t, '{'|'.join(ws)}') THEN '{n}'" for n, ws in Rel.CATEGORIES) + " ELSE 'other' END"


@query("ui_01_edge_category", f"WITH t AS (SELECT conv_id, turn, lower(role || ' ' || text) AS t FROM conversations) SELECT conv_id, turn, {_UI} AS category FROM t")
def ui_01(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", Rel.category(F.col("role"), F.col("text")).alias("category"))


@query("ui_02_renderable_subgraph", f"WITH {TE_CTE}, k AS (SELECT * FROM ent WHERE type = 'character'), g AS (SELECT te.doc_id, source, target FROM te WHERE EXISTS (SELECT 1 FROM k WHERE k.doc_id = te.doc_id AND slug = source) AND EXISTS (SELECT 1 FROM k WHERE k.doc_id = te.doc_id AND slug = target)) SELECT doc_id, source AS node FROM g UNION SELECT doc_id, target FROM g")
def ui_02(spark, sf_dir):
    g = M.induced(entities(spark, sf_dir).where("type = 'character'"), text_edges(spark, sf_dir))
    return g.select("doc_id", F.col("source").alias("node")).union(g.select("doc_id", "target")).distinct()


@query("ui_03_inline_ranges", f"""WITH {M_CTE}, r AS (SELECT DISTINCT m.doc_id, m.paragraph_index, instr(text, name) - 1 AS a, instr(text, name) - 1 + length(name) AS b FROM m JOIN p ON p.doc_id = m.doc_id AND p.paragraph_index = m.paragraph_index),
f AS (SELECT doc_id, paragraph_index, min((a, b)) AS x FROM r GROUP BY 1, 2), s AS (SELECT r.doc_id, r.paragraph_index, min((a, b)) AS x FROM r JOIN f ON f.doc_id = r.doc_id AND f.paragraph_index = r.paragraph_index WHERE a >= f.x[2] GROUP BY 1, 2)
SELECT doc_id, paragraph_index, CAST(x[1] AS BIGINT) AS start, CAST(x[2] AS BIGINT) AS "end" FROM (SELECT * FROM f UNION ALL SELECT * FROM s)""")
def ui_03(spark, sf_dir):
    """Where the names of a paragraph stand in it, as ranges that don't overlap, two at most: a fold over the ordered ranges."""
    m = slugged(spark, sf_dir).join(_texts(spark, sf_dir), ["doc_id", "paragraph_index"])
    at = F.instr("text", F.col("name")) - 1
    rows = m.select("doc_id", "paragraph_index", F.struct(at.alias("start"), (at + F.length("name")).alias("end")).alias("r"))
    lists = rows.groupBy("doc_id", "paragraph_index").agg(F.array_sort(F.collect_set("r")).alias("rs"))
    kind = "array<struct<start:int,end:int>>"

    def take(acc, r):
        free = (F.size(acc) < 2) & F.forall(acc, lambda x: x["end"] <= r["start"])
        return F.when(free, F.array_append(acc, r)).otherwise(acc)

    kept = lists.select("doc_id", "paragraph_index", F.explode(F.aggregate("rs", F.array().cast(kind), take)).alias("r"))
    return kept.select("doc_id", "paragraph_index", F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("end"))
