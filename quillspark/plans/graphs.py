"""Entities (ENT), graph assembly and traversal (GRF) and visibility (VIS) over the documents' names and the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunks as C
from quillspark.operators import entities as E
from quillspark.operators import graph as G
from quillspark.plans.registry import query
from quillspark.plans.relations import ED_CTE, star_relations
from quillspark.plans.views import M_CTE, P_CTE, mentions, paragraphs, star_edges, table

_TYPE = "CASE (ascii(slug) + length(slug)) % 3 WHEN 0 THEN 'character' WHEN 1 THEN 'location' ELSE 'concept' END"
#: Entities of each document; a name's type follows from its letters.
EN_CTE = f"""{M_CTE},
en AS (SELECT doc_id, lower(name) AS slug, min(name) AS name, count(*) AS mention_count, min((chapter_index, paragraph_index)) AS f, max((chapter_index, paragraph_index)) AS l,
  list_sort(list(DISTINCT chapter_index)) AS chapters FROM m GROUP BY 1, 2),
ent AS (SELECT *, {_TYPE} AS type, f[1] AS first_chapter, f[2] AS first_paragraph, l[1] AS last_chapter, l[2] AS last_paragraph FROM en)"""


def slugged(spark, sf_dir, by_book=True):
    return mentions(spark, sf_dir, by_book).withColumn("slug", F.lower("name"))


def entities(spark, sf_dir, found_names=None):
    """found_names: what slugged() returns, where it is at hand."""
    found = E.from_mentions(slugged(spark, sf_dir) if found_names is None else found_names, ["doc_id"])
    return found.select(
        "doc_id", "slug", "name", "mention_count", "chapters", F.expr(_TYPE).alias("type"),
        F.col("first_seen.chapter_index").alias("first_chapter"), F.col("first_seen.paragraph_index").alias("first_paragraph"),
        F.col("last_seen.chapter_index").alias("last_chapter"), F.col("last_seen.paragraph_index").alias("last_paragraph"),
    )


def episodes(spark, sf_dir, found_names=None):
    """(doc_id, chapter_index, paragraph_index, names): paragraphs with at least one name."""
    found = slugged(spark, sf_dir) if found_names is None else found_names
    return found.groupBy("doc_id", "chapter_index", "paragraph_index").agg(F.array_sort(F.collect_set("slug")).alias("names"))


EP_CTE = f"{M_CTE}, ep AS (SELECT doc_id, chapter_index, paragraph_index, list_sort(list(DISTINCT lower(name))) AS names FROM m GROUP BY 1, 2, 3)"


def text_edges(spark, sf_dir, found_names=None):
    """Edges between names that follow each other in a paragraph: weight, first and last paragraph."""
    w = Window.partitionBy("doc_id", "paragraph_index").orderBy("ord")
    pairs = (slugged(spark, sf_dir) if found_names is None else found_names).withColumn("next", F.lead("slug").over(w)).where("next is not null")
    return pairs.groupBy("doc_id", F.least("slug", "next").alias("source"), F.greatest("slug", "next").alias("target")).agg(
        F.count("*").alias("weight"), F.min("paragraph_index").alias("valid_at"), F.max("paragraph_index").alias("last_at")
    )


TE_CTE = f"""{EN_CTE}, nx AS (SELECT doc_id, paragraph_index, lower(name) AS s, lower(lead(name) OVER (PARTITION BY doc_id, paragraph_index ORDER BY ord)) AS t FROM m),
te AS (SELECT doc_id, least(s, t) AS source, greatest(s, t) AS target, count(*) AS weight, min(paragraph_index) AS valid_at, max(paragraph_index) AS last_at FROM nx WHERE t IS NOT NULL GROUP BY 1, 2, 3)"""


@query("ent_01_aliases", f"WITH {P_CTE} SELECT DISTINCT doc_id, n AS name, array_to_string(list_sort(list_distinct([n, string_split(n, ' ')[-1]])), '|') AS aliases FROM (SELECT doc_id, trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g')) AS n FROM p)")
def ent_01(spark, sf_dir):
    n = paragraphs(spark, sf_dir).select("doc_id", T.collapse("text").alias("name")).distinct()
    return n.select("doc_id", "name", F.array_join(E.aliases("name"), "|").alias("aliases"))


_NAMES = "CASE c_custkey % 4 WHEN 0 THEN '堂何塞·' || c_custkey || '上校' WHEN 1 THEN '唐' || c_custkey || '先生' WHEN 2 THEN 'Ana·' || c_custkey ELSE '李' || c_custkey || '将军小姐' END"
_VAR = """CASE k WHEN 0 THEN list_value('堂何塞_' || c || '上校', '何塞_' || c || '上校', '何塞_' || c) WHEN 1 THEN list_distinct(list_value('唐' || c || '先生', c || '先生', CASE WHEN length(c) > 1 THEN c ELSE c || '先生' END)) WHEN 2 THEN list_value('ana_' || c) ELSE list_value('李' || c || '将军小姐', '李' || c || '将军') END"""


@query("ent_02_name_variants", f"SELECT CAST(c AS BIGINT) AS c_custkey, unnest({_VAR}) AS variant FROM (SELECT CAST(c_custkey AS VARCHAR) AS c, c_custkey % 4 AS k FROM customer)")
def ent_02(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(E.variants(F.expr(_NAMES))).alias("variant"))


@query("ent_03_resolve")
def ent_03(spark, sf_dir):
    ents = entities(spark, sf_dir).groupBy("slug").agg(F.sum("mention_count").alias("mention_count"), F.min("name").alias("name"))
    registry = ents.select(F.concat(F.lit("entity_"), "slug").alias("entity_id"), "slug", F.when(F.ascii("slug") % 2 == 0, "alias").otherwise("fuzzy").alias("kind"), "mention_count")
    cands = entities(spark, sf_dir).select(F.concat_ws(":", "doc_id", "slug").alias("cand_id"), "name", F.when(F.ascii("slug") % 5 == 0, F.col("name")).alias("hint"))
    return E.resolve(cands, registry)


@query("ent_04_entities", f"WITH {EN_CTE} SELECT doc_id, slug, name, mention_count, type, first_chapter, first_paragraph, last_chapter, last_paragraph, array_to_string(chapters, ',') AS chapters FROM ent")
def ent_04(spark, sf_dir):
    return entities(spark, sf_dir).withColumn("chapters", F.array_join(F.transform("chapters", lambda c: c.cast("string")), ","))


@query(
    "ent_05_match_in_episode",
    f"""WITH {M_CTE}, a AS (SELECT doc_id, paragraph_index, lower(name) AS wanted FROM m UNION SELECT doc_id, paragraph_index, lower(left(name, 4)) FROM m),
h AS (SELECT a.doc_id, a.paragraph_index, wanted, name, ord, CASE WHEN wanted = lower(name) THEN 0 ELSE 1 END AS rank FROM a JOIN m ON a.doc_id = m.doc_id AND a.paragraph_index = m.paragraph_index WHERE contains(lower(name), wanted) OR contains(wanted, lower(name)))
SELECT doc_id, paragraph_index, wanted, min_by(name, (rank, ord)) AS entity, CAST(min(rank) AS BIGINT) AS rank FROM h GROUP BY 1, 2, 3""",
)
def ent_05(spark, sf_dir):
    m = mentions(spark, sf_dir)
    forms = F.array_distinct(F.array(F.lower("name"), F.lower(F.substring("name", 1, 4))))  # whole and cut short
    names = m.select("doc_id", "paragraph_index", F.explode(forms).alias("wanted")).distinct()
    return E.match_in_episode(names, m.select("doc_id", "paragraph_index", F.col("name").alias("entity"), "ord"), ["doc_id", "paragraph_index"])


@query(
    "ent_06_chapter_survivors",
    f"""WITH {M_CTE}, c AS (SELECT chapter_index, lower(name) AS slug, doc_id, count(*) AS mention_count FROM m GROUP BY 1, 2, 3)
SELECT chapter_index, slug, doc_id AS entity_id, first_value(doc_id) OVER (PARTITION BY chapter_index, slug ORDER BY mention_count DESC, doc_id DESC) AS survivor FROM c""",
)
def ent_06(spark, sf_dir):
    c = slugged(spark, sf_dir).groupBy("chapter_index", "slug", F.col("doc_id").alias("entity_id")).agg(F.count("*").alias("mention_count"))
    return E.chapter_survivors(c, ["chapter_index", "slug"]).drop("mention_count")


@query(
    "ent_07_alias_merges",
    f"""WITH {EN_CTE}, g AS (SELECT slug, min(name) AS name, ascii(slug) % 2 AS type, CAST(sum(mention_count) AS BIGINT) AS n FROM ent GROUP BY 1),
al AS (SELECT slug AS o, type AS ot, n AS onn, unnest(list_distinct([name, name || 'n', left(name, length(name) - 1)])) AS alias FROM g WHERE length(name) > 3),
fam AS (SELECT slug AS a, slug || 'n' AS b FROM g WHERE n % 2 = 0),
pr AS (SELECT slug, n, onn, o FROM g JOIN al ON name = alias AND type = ot AND slug <> o WHERE NOT EXISTS (SELECT 1 FROM fam WHERE (a = slug AND b = o) OR (a = o AND b = slug))),
be AS (SELECT slug, n, max((onn, o)) AS x FROM pr GROUP BY 1, 2)
SELECT DISTINCT CASE WHEN x[1] >= n THEN slug ELSE x[2] END AS absorbed, CASE WHEN x[1] >= n THEN x[2] ELSE slug END AS survivor FROM be""",
)
def ent_07(spark, sf_dir):
    g = entities(spark, sf_dir).groupBy("slug").agg(F.min("name").alias("name"), (F.ascii(F.first("slug")) % 2).alias("type"), F.sum("mention_count").alias("mention_count"))
    forms = F.array_distinct(F.array(F.col("name"), F.concat("name", F.lit("n")), F.substring(F.col("name"), F.lit(1), F.length("name") - 1)))
    ents = g.select(F.col("slug").alias("entity_id"), "name", "type", F.when(F.length("name") > 3, forms).alias("aliases"), "mention_count")
    family = g.where("mention_count % 2 = 0").select(F.col("slug").alias("a"), F.concat("slug", F.lit("n")).alias("b"))
    return E.alias_merges(ents, family)


@query(
    "ent_08_summaries",
    f"""WITH {TE_CTE}, fa AS (SELECT doc_id, source AS slug, source || ' ~ ' || target AS fact FROM te WHERE weight > 1),
fs AS (SELECT doc_id, slug, array_to_string(list_transform(list_sort(list((-length(fact), fact)))[1:3], lambda x: x[2]), '；') AS facts FROM fa GROUP BY 1, 2)
SELECT ent.doc_id, ent.slug, CASE WHEN facts IS NOT NULL THEN name || ' — ' || facts ELSE name || '（' || CASE type WHEN 'character' THEN '角色' WHEN 'location' THEN '地点' ELSE '概念/主题' END || '）' END || '。出现在 ' ||
  CASE WHEN chapters[1] = chapters[-1] THEN 'ch' || chapters[1] ELSE 'ch' || chapters[1] || '-' || chapters[-1] END || '，共 ' || mention_count || ' 次提及。' || CASE WHEN mention_count = 1 AND type = 'character' THEN ' 仅出现一次，可能为零散提及。' ELSE '' END AS summary
FROM ent LEFT JOIN fs ON ent.doc_id = fs.doc_id AND ent.slug = fs.slug""",
)
def ent_08(spark, sf_dir):
    facts = text_edges(spark, sf_dir).where("weight > 1").select("doc_id", F.col("source").alias("slug"), F.concat("source", F.lit(" ~ "), "target").alias("fact"))
    return E.summaries(entities(spark, sf_dir), facts, ["doc_id"]).select("doc_id", "slug", "summary")


@query("ent_09_rebuild_state", rf"""WITH {EN_CTE}, f AS (SELECT doc_id, doc_id || ':' || slug AS entity_id, last_chapter, unnest(list_distinct([name, string_split(name, ' ')[-1]])) AS form FROM ent),
a AS (SELECT *, coalesce(nullif(regexp_replace(regexp_replace(lower(form), '[^a-z0-9一-鿿]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS alias FROM f)
SELECT doc_id, alias, min(entity_id) AS entity_id, max(last_chapter) AS last_chapter FROM a GROUP BY 1, 2""")
def ent_09(spark, sf_dir):
    """Index state as a resumed build needs it: alias -> entity, last version and last chapter of each."""
    e = entities(spark, sf_dir)
    forms = e.select("doc_id", F.concat_ws(":", "doc_id", "slug").alias("entity_id"), "last_chapter", F.explode(F.array_distinct(F.transform(E.aliases("name"), lambda a: T.slugify(a)))).alias("alias"))
    return forms.groupBy("doc_id", "alias").agg(F.min("entity_id").alias("entity_id"), F.max("last_chapter").alias("last_chapter"))


@query(
    "ent_10_method_comparison",
    f"""WITH {EN_CTE} SELECT type AS method, count(*) AS total, count(*) FILTER (mention_count = 1) AS fragments, count(*) FILTER (mention_count >= 4) AS mc4, count(*) FILTER (mention_count >= 10) AS mc10,
floor(count(*) FILTER (mention_count = 1) * 1000.0::DOUBLE / count(*) + 0.5) / 10 AS fragment_pct FROM ent GROUP BY 1""",
)
def ent_10(spark, sf_dir):
    g = entities(spark, sf_dir).groupBy(F.col("type").alias("method")).agg(F.count("*").alias("total"), F.count_if(F.col("mention_count") == 1).alias("fragments"), F.count_if(F.col("mention_count") >= 4).alias("mc4"), F.count_if(F.col("mention_count") >= 10).alias("mc10"))
    return g.withColumn("fragment_pct", F.floor(F.col("fragments") * 1000.0 / F.col("total") + 0.5) / 10)


@query("grf_01_build", f"WITH {TE_CTE} SELECT 'episode' AS kind, count(*) AS n FROM (SELECT DISTINCT doc_id, paragraph_index FROM m) UNION ALL SELECT 'entity', count(*) FROM ent UNION ALL SELECT 'relation', count(*) FROM te")
def grf_01(spark, sf_dir):
    parts = {"episode": episodes(spark, sf_dir), "entity": entities(spark, sf_dir), "relation": text_edges(spark, sf_dir)}
    out = None
    for kind, df in parts.items():
        one = df.select(F.lit(kind).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("grf_02_prev_next", f"WITH {P_CTE} SELECT doc_id, paragraph_index, lag(paragraph_index) OVER w AS prev, lead(paragraph_index) OVER w AS next FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY chapter_index, paragraph_index)")
def grf_02(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("chapter_index", "paragraph_index")
    return paragraphs(spark, sf_dir).select("doc_id", "paragraph_index", F.lag("paragraph_index").over(w).alias("prev"), F.lead("paragraph_index").over(w).alias("next"))


@query(
    "grf_03_dependencies",
    f"""WITH {EP_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chapter_index ORDER BY paragraph_index) AS rn FROM ep)
SELECT a.doc_id, a.chapter_index, a.paragraph_index, b.paragraph_index AS depends_on FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.chapter_index = b.chapter_index AND b.rn BETWEEN a.rn - 4 AND a.rn - 1
WHERE b.rn = a.rn - 1 OR len(list_intersect(a.names, b.names)) >= 2""",
)
def grf_03(spark, sf_dir):
    return G.dependencies(episodes(spark, sf_dir), ["doc_id", "chapter_index"])


@query(
    "grf_04_neighbors",
    f"""WITH {ED_CTE}, a AS (SELECT source, target, weight FROM sup WHERE invalidated_by IS NULL), u AS (SELECT source AS node, target AS neighbor, weight FROM a UNION ALL SELECT target, source, weight FROM a)
SELECT node, neighbor, weight, row_number() OVER (PARTITION BY node ORDER BY weight DESC, neighbor DESC) AS rank FROM u""",
)
def grf_04(spark, sf_dir):
    active = star_relations(spark, sf_dir).where("status = 'active'").select("source", "target", "weight")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), F.desc("neighbor"))).cast("long")
    return G.both_ways(active).select("node", "neighbor", "weight", rank.alias("rank"))


@query("grf_05_pair_lookup", f"""WITH {ED_CTE}, w AS (SELECT DISTINCT 'c' || o_custkey AS a, 's' || l_suppkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 100 = 0)
SELECT a, b, signature, valid_at, weight, row_number() OVER (PARTITION BY a, b ORDER BY valid_at, signature) AS rank FROM sup JOIN w ON least(source, target) = least(a, b) AND greatest(source, target) = greatest(a, b)""")
def grf_05(spark, sf_dir):
    """The pairs looked up are those of all customers whose number is divisible by 100 with the suppliers that they have dealt with; a pair's relations, whichever way they point, by time.
    A relation begins at a customer and what ends it begins there, too, so that those of all other customers need not be made."""
    asked = "o_custkey % 100 = 0"
    wanted = star_edges(spark, sf_dir, asked).select(F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    return G.pair_relations(star_relations(spark, sf_dir, asked), wanted).select("a", "b", "signature", "valid_at", "weight", "rank")


@query(
    "grf_06_ego_network",
    f"""WITH {TE_CTE}, seed AS (SELECT doc_id, max_by(slug, (mention_count, slug)) AS seed FROM ent WHERE type = 'character' GROUP BY 1)
SELECT te.doc_id, seed, CASE WHEN source = seed THEN target ELSE source END AS neighbor, weight, ent.mention_count, valid_at, left(p.text, 300) AS evidence
FROM te JOIN seed ON te.doc_id = seed.doc_id AND (source = seed OR target = seed) JOIN ent ON ent.doc_id = te.doc_id AND ent.slug = CASE WHEN source = seed THEN target ELSE source END
LEFT JOIN p ON p.doc_id = te.doc_id AND p.paragraph_index = valid_at""",
)
def grf_06(spark, sf_dir):
    ents = entities(spark, sf_dir)
    seed = ents.where("type = 'character'").groupBy("doc_id").agg(F.max_by("slug", F.struct("mention_count", "slug")).alias("node"))
    around = G.both_ways(text_edges(spark, sf_dir).withColumn("d", F.col("doc_id")).select("source", "target", "doc_id", "weight", "valid_at")).join(seed, ["doc_id", "node"])
    near = around.join(ents.select("doc_id", F.col("slug").alias("neighbor"), "mention_count"), ["doc_id", "neighbor"])
    text = paragraphs(spark, sf_dir).select("doc_id", F.col("paragraph_index").alias("valid_at"), F.substring("text", 1, 300).alias("evidence"))
    return near.join(text, ["doc_id", "valid_at"], "left").select("doc_id", F.col("node").alias("seed"), "neighbor", "weight", "mention_count", "valid_at", "evidence")


@query(
    "grf_07_communities",
    f"""WITH RECURSIVE {TE_CTE}, g AS (SELECT doc_id || ':' || source AS u, doc_id || ':' || target AS v FROM te), b AS (SELECT u, v FROM g UNION SELECT v, u FROM g),
walk(node, reach) AS (SELECT u, u FROM b UNION SELECT walk.node, b.v FROM walk JOIN b ON walk.reach = b.u)
SELECT node, min(reach) AS component FROM walk GROUP BY 1""",
)
def grf_07(spark, sf_dir):
    """No edge leaves its book."""
    c = G.components_within(text_edges(spark, sf_dir).select("doc_id", "source", "target"), "doc_id")
    return c.select(F.concat_ws(":", "doc_id", "node").alias("node"), F.concat_ws(":", "doc_id", "component").alias("component"))


SG_CTE = f"""{EP_CTE}, ch AS (SELECT doc_id, chapter_index, list_sort(list_distinct(flatten(list(names)))) AS names FROM ep GROUP BY 1, 2),
o AS (SELECT *, CASE WHEN coalesce(list_has_any(names, lag(names) OVER (PARTITION BY doc_id ORDER BY chapter_index)), false) THEN 0 ELSE 1 END AS opens FROM ch),
sg AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY chapter_index) AS run FROM o)"""


def chapter_names(spark, sf_dir):
    return episodes(spark, sf_dir).groupBy("doc_id", "chapter_index").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))


@query("grf_08_sagas", f"WITH {SG_CTE} SELECT doc_id, CAST(run AS BIGINT) AS run, min(chapter_index) AS chapter_start, max(chapter_index) AS chapter_end, count(*) AS n_chapters FROM sg GROUP BY 1, 2")
def grf_08(spark, sf_dir):
    g = G.runs(chapter_names(spark, sf_dir), "doc_id", "chapter_index", "names").groupBy("doc_id", "run")
    return g.agg(F.min("chapter_index").alias("chapter_start"), F.max("chapter_index").alias("chapter_end"), F.count("*").alias("n_chapters"))


@query("grf_09_timeline", f"WITH {P_CTE} SELECT doc_id, chapter_index, count(*) AS n_episodes, min(paragraph_index) AS first_paragraph, max(CASE WHEN chapter_index <= 1 THEN 0 WHEN chapter_index <= 3 THEN 1 ELSE 2 END)::BIGINT AS spoiler_level FROM p GROUP BY 1, 2")
def grf_09(spark, sf_dir):
    return paragraphs(spark, sf_dir).groupBy("doc_id", "chapter_index").agg(F.count("*").alias("n_episodes"), F.min("paragraph_index").alias("first_paragraph"), F.max(C.spoiler_level(F.col("chapter_index"))).cast("long").alias("spoiler_level"))


#: Text edges as relations of four types in three families; one that is not seen again within eight paragraphs is gone.
_REL = """CASE (length(source) + length(target)) % 4 WHEN 0 THEN 'SPOKE_WITH' WHEN 1 THEN 'FAMILY_OF' WHEN 2 THEN 'CARES_ABOUT' ELSE 'VISITED' END AS relation_type,
  CASE (length(source) + length(target)) % 4 WHEN 1 THEN 'kinship' WHEN 2 THEN 'kinship' WHEN 0 THEN 'contact' ELSE 'place' END AS state_family,
  CASE WHEN weight > 1 AND last_at - valid_at > 8 THEN 'invalidated' ELSE 'active' END AS status"""


def text_relations(spark, sf_dir, found_names=None):
    """text_edges() with relation_type, state_family, status and chapter_index."""
    chapter = (F.floor((F.col("valid_at") - 1) / 8) + 1).alias("chapter_index")
    return text_edges(spark, sf_dir, found_names).selectExpr("*", *_REL.split(",\n")).select("*", chapter)


@query(
    "grf_10_stats",
    f"""WITH {TE_CTE}, ep AS (SELECT doc_id, chapter_index, paragraph_index, list(DISTINCT lower(name)) AS names FROM m GROUP BY 1, 2, 3),
re AS (SELECT *, {_REL}, (valid_at - 1) // 8 + 1 AS chapter_index FROM te),
rt AS (SELECT doc_id, relation_type, count(*) AS n FROM re GROUP BY 1, 2),
rc AS (SELECT doc_id, chapter_index, count(*) AS r, count(*) FILTER (status = 'active') AS a, count(*) FILTER (status = 'invalidated') AS g FROM re GROUP BY 1, 2),
de AS (SELECT e.*, coalesce(r, 0) AS r, coalesce(a, 0) AS a, coalesce(g, 0) AS g FROM (SELECT doc_id, chapter_index, count(*) AS n, len(list_distinct(flatten(list(names)))) AS d FROM ep GROUP BY 1, 2) e LEFT JOIN rc ON rc.doc_id = e.doc_id AND rc.chapter_index = e.chapter_index),
al AS (SELECT doc_id, 'count' AS section, 'chapter_count' AS name, 0 AS rank, count(DISTINCT chapter_index) AS n FROM ep GROUP BY 1 UNION ALL SELECT doc_id, 'count', 'episode_count', 0, count(*) FROM ep GROUP BY 1
UNION ALL SELECT doc_id, 'count', 'max_chapter_index', 0, max(chapter_index) FROM ep GROUP BY 1 UNION ALL SELECT doc_id, 'count', 'max_paragraph_index', 0, max(paragraph_index) FROM ep GROUP BY 1
UNION ALL SELECT doc_id, 'count', 'entity_count', 0, count(*) FROM ent GROUP BY 1 UNION ALL SELECT doc_id, 'count', 'relation_count', 0, count(*) FROM re GROUP BY 1
UNION ALL SELECT doc_id, 'count', 'active_relation_count', 0, count(*) FILTER (status = 'active') FROM re GROUP BY 1 UNION ALL SELECT doc_id, 'count', 'invalidated_relation_count', 0, count(*) FILTER (status = 'invalidated') FROM re GROUP BY 1
UNION ALL SELECT doc_id, 'entity_type', type, 0, count(*) FROM ent GROUP BY 1, 3 UNION ALL SELECT doc_id, 'relation_family', state_family, 0, count(*) FROM re GROUP BY 1, 3
UNION ALL SELECT doc_id, 'top_entity', slug, k, mention_count FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mention_count DESC, slug) AS k FROM ent) WHERE k <= 5
UNION ALL SELECT doc_id, 'top_relation_type', relation_type, k, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, relation_type) AS k FROM rt) WHERE k <= 5
UNION ALL SELECT doc_id, 'density_episodes', chapter_index::VARCHAR, 0, n FROM de UNION ALL SELECT doc_id, 'density_entities', chapter_index::VARCHAR, 0, d FROM de
UNION ALL SELECT doc_id, 'density_relations', chapter_index::VARCHAR, 0, r FROM de UNION ALL SELECT doc_id, 'density_active', chapter_index::VARCHAR, 0, a FROM de UNION ALL SELECT doc_id, 'density_invalidated', chapter_index::VARCHAR, 0, g FROM de)
SELECT doc_id, section, name, CAST(rank AS BIGINT) AS rank, CAST(n AS BIGINT) AS n FROM al""",
)
def grf_10(spark, sf_dir):
    found = G.shared_table(slugged(spark, sf_dir, by_book=False), "names")
    return G.stats(episodes(spark, sf_dir, found), entities(spark, sf_dir, found), text_relations(spark, sf_dir, found))


@query("grf_11_generations", "WITH RECURSIVE par AS (SELECT DISTINCT n_regionkey AS parent, 100 + n_nationkey AS child FROM nation UNION SELECT DISTINCT 100 + s_nationkey, 1000 + s_suppkey FROM supplier UNION SELECT 1001, 0), walk(node, generation) AS (SELECT DISTINCT parent, 0 FROM par WHERE parent NOT IN (SELECT child FROM par) UNION SELECT child, generation + 1 FROM walk JOIN par ON parent = node WHERE generation < 20) SELECT CAST(node AS BIGINT) AS node, CAST(min(generation) AS BIGINT) AS generation FROM walk GROUP BY 1")
def grf_11(spark, sf_dir):
    """Regions over nations over suppliers; supplier 1 over region 0 closes a cycle, whose members stay without a number unless another root reaches them."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("parent"), (F.lit(100) + F.col("n_nationkey")).cast("long").alias("child"))
    supplier = table(spark, sf_dir, "supplier").select((F.lit(100) + F.col("s_nationkey")).cast("long").alias("parent"), (F.lit(1000) + F.col("s_suppkey")).alias("child"))
    loop = spark.range(1).select(F.lit(1001).cast("long").alias("parent"), F.lit(0).cast("long").alias("child"))
    return G.generations(spark, nation.union(supplier).union(loop).distinct())


@query("grf_12_browse", f"WITH {EN_CTE} SELECT doc_id, slug, mention_count FROM ent WHERE first_chapter <= 2 ORDER BY mention_count DESC, doc_id, slug LIMIT 50")
def grf_12(spark, sf_dir):
    return entities(spark, sf_dir).where("first_chapter <= 2").orderBy(F.desc("mention_count"), "doc_id", "slug").limit(50).select("doc_id", "slug", "mention_count")


@query("grf_13_chapter_window", f"WITH {P_CTE} SELECT doc_id, chapter_index, paragraph_index FROM p WHERE chapter_index BETWEEN 2 AND 3")
def grf_13(spark, sf_dir):
    return paragraphs(spark, sf_dir).where("chapter_index between 2 and 3").select("doc_id", "chapter_index", "paragraph_index")


@query("grf_14_as_of", f"WITH {ED_CTE} SELECT source, target, weight FROM sup WHERE valid_at <= TIMESTAMP '1995-06-30' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '1995-06-30')")
def grf_14(spark, sf_dir):
    at = "TIMESTAMP '1995-06-30'"
    return star_relations(spark, sf_dir).where(f"valid_at <= {at} and (invalid_at is null or invalid_at > {at})").select("source", "target", "weight")


_GATE = "(chapter_index < 2 OR (chapter_index = 2 AND paragraph_index <= 12))"


@query("vis_01_gate", f"WITH {P_CTE} SELECT doc_id, chapter_index, paragraph_index FROM p WHERE {_GATE}")
def vis_01(spark, sf_dir):
    return paragraphs(spark, sf_dir).where(G.visible(F.col("chapter_index"), F.col("paragraph_index"), 2, 12)).select("doc_id", "chapter_index", "paragraph_index")


_VIS2 = "chapter_index < 2 OR (chapter_index = 2 AND paragraph_index <= 12 AND NOT (token_offset <> 0 AND token_offset > 300 AND paragraph_index = 12))"


@query("vis_02_progress", f"WITH {P_CTE}, c AS (SELECT doc_id, chapter_index, paragraph_index, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY paragraph_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS token_offset FROM p) SELECT doc_id, paragraph_index FROM c WHERE {_VIS2}")
def vis_02(spark, sf_dir):
    before = Window.partitionBy("doc_id").orderBy("paragraph_index").rowsBetween(Window.unboundedPreceding, -1)
    return paragraphs(spark, sf_dir).withColumn("token_offset", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(_VIS2).select("doc_id", "paragraph_index")


@query("vis_03_recent_window", f"WITH {EP_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index DESC) AS k FROM ep WHERE {_GATE}), v AS (SELECT * FROM r WHERE k <= 3) SELECT DISTINCT doc_id, unnest(names) AS slug FROM v")
def vis_03(spark, sf_dir):
    seen = episodes(spark, sf_dir).where(G.visible(F.col("chapter_index"), F.col("paragraph_index"), 2, 12))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("paragraph_index")))
    return seen.withColumn("k", k).where("k <= 3").select("doc_id", F.explode("names").alias("slug")).distinct()


@query("vis_04_entities", f"WITH {EN_CTE} SELECT doc_id, slug FROM ent WHERE (first_chapter < 3 OR (first_chapter = 3 AND first_paragraph <= 20)) AND last_chapter >= 2")
def vis_04(spark, sf_dir):
    return entities(spark, sf_dir).where(G.visible(F.col("first_chapter"), F.col("first_paragraph"), 3, 20) & (F.col("last_chapter") >= 2)).select("doc_id", "slug")


@query("vis_05_filters", f"WITH {ED_CTE} SELECT signature, weight FROM sup WHERE weight >= 2 AND invalidated_by IS NULL AND source IN (SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def vis_05(spark, sf_dir):
    seg = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), "c_custkey").alias("source"))
    return star_relations(spark, sf_dir).where("weight >= 2 and status = 'active'").join(seg, "source", "left_semi").select("signature", "weight")


@query("vis_06_guardrail_trace", f"WITH {P_CTE} SELECT doc_id, count(*) FILTER ({_GATE}) AS visible_count, count(*) FILTER (NOT {_GATE}) AS filtered_count, CASE WHEN doc_id % 3 = 0 THEN 'selection_anchor_after_progress' ELSE '' END AS warnings FROM p GROUP BY doc_id")
def vis_06(spark, sf_dir):
    gate = G.visible(F.col("chapter_index"), F.col("paragraph_index"), 2, 12)
    g = paragraphs(spark, sf_dir).groupBy("doc_id").agg(F.count_if(gate).alias("visible_count"), F.count_if(~gate).alias("filtered_count"))
    return g.withColumn("warnings", F.when(F.col("doc_id") % 3 == 0, "selection_anchor_after_progress").otherwise(""))


@query(
    "vis_07_selection_filters",
    f"""WITH {M_CTE}, s AS (SELECT doc_id, lower(text) AS selected FROM p WHERE paragraph_index = 2),
c AS (SELECT m.doc_id, paragraph_index, ord, trim(regexp_replace(lower(name), '[^a-z0-9一-鿿]+', '_', 'g'), '_') AS label, selected FROM m JOIN s ON m.doc_id = s.doc_id WHERE {_GATE}),
k AS (SELECT doc_id, label, min((paragraph_index, ord)) AS pos FROM c WHERE (paragraph_index = 2 OR contains(selected, replace(label, '_', ' '))) AND label NOT IN ('', 'the', 'when', 'chapter', 'unknown_characters') GROUP BY 1, 2)
SELECT doc_id, string_agg(label, ',' ORDER BY pos) AS character_filters FROM k GROUP BY 1""",
)
def vis_07(spark, sf_dir):
    selected = paragraphs(spark, sf_dir).where("paragraph_index = 2").select("doc_id", F.lower("text").alias("selected"))
    label = T.slugify("name", fallback="")
    c = mentions(spark, sf_dir).where(G.visible(F.col("chapter_index"), F.col("paragraph_index"), 2, 12)).join(selected, "doc_id").withColumn("label", label)
    hit = (F.col("paragraph_index") == 2) | F.contains("selected", F.replace("label", F.lit("_"), F.lit(" ")))
    k = c.where(hit & ~F.col("label").isin("", "the", "when", "chapter", "unknown_characters")).groupBy("doc_id", "label").agg(F.min(F.struct("paragraph_index", "ord")).alias("at"))
    return k.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]), ",").alias("character_filters"))


# What a question that asks for what is to come contains.
SPOILER_HINTS = ("结局", "最后", "后来", "真相", "凶手", "反转", "最终", "who dies", "ending", "later", "final", "spoiler")


@query("vis_08_spoiler_questions", f"SELECT conv_id, turn, regexp_matches(lower(text), '{'|'.join(SPOILER_HINTS)}') AS spoiler FROM conversations")
def vis_08(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("text").rlike("|".join(SPOILER_HINTS)).alias("spoiler"))


@query("vis_09_chapter_gate", f"WITH {P_CTE} SELECT doc_id, paragraph_index FROM p WHERE coalesce(CASE WHEN paragraph_index % 2 = 0 THEN chapter_index + 1 END, chapter_index) <= 2")
def vis_09(spark, sf_dir):
    position = F.when(F.col("paragraph_index") % 2 == 0, F.col("chapter_index") + 1)
    return paragraphs(spark, sf_dir).where(F.coalesce(position, F.col("chapter_index")) <= 2).select("doc_id", "paragraph_index")
