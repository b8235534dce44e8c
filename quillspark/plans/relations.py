"""Relations (REL) over facts made of paragraphs and over the star schema's facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import relations as R
from quillspark.plans.registry import query
from quillspark.plans.views import E_CTE, M_CTE, ORD, ORD_SQL, mentions, star_edges

_RAW = ["LIVES_IN", " owns", "MEMBER_OF", "talked_to", "LOVES", "WORSHIPS", "LOCATED_IN", "OWNS"]
_ADD = ["", " found", " he died", " they cast into it", " the leader", " guided"]
_TARGETS = ["character", "artifact", "location"]


def _pick(values, key):
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def _sql_pick(values, key):
    return f"(list_value({', '.join(f'{chr(39)}{v}{chr(39)}' for v in values)}))[CAST({key} % {len(values)} + 1 AS INTEGER)]"


def text_facts(spark, sf_dir):
    """Paragraphs as facts between their first two names; type, wording and target type go round."""
    m = mentions(spark, sf_dir)
    pairs = m.groupBy("doc_id", "chapter_index", "paragraph_index").agg(F.min_by("name", "ord").alias("a"), F.max_by("name", "ord").alias("b"), F.count("*").alias("n")).where("n > 1")
    key = F.col("doc_id") + F.col("paragraph_index")
    return pairs.withColumn("k", key).select(
        "doc_id",
        "chapter_index",
        "paragraph_index",
        F.lower("a").alias("source"),
        F.lower("b").alias("target"),
        _pick(_RAW, "k").alias("raw_type"),
        F.when(F.col("k") % 5 == 0, "location").otherwise("context").alias("raw_family"),
        F.when(F.col("k") % 7 == 0, "undirected").otherwise("").alias("raw_directionality"),
        F.concat("a", F.lit(" and "), "b", _pick(_ADD, "k")).alias("fact"),
        _pick(_TARGETS, "doc_id").alias("target_type"),
    )


F_CTE = f"""{M_CTE},
fp AS (SELECT doc_id, chapter_index, paragraph_index, min_by(name, ord) AS a, max_by(name, ord) AS b, doc_id + paragraph_index AS k FROM m GROUP BY 1, 2, 3 HAVING count(*) > 1),
facts AS (SELECT doc_id, chapter_index, paragraph_index, lower(a) AS source, lower(b) AS target, {_sql_pick(_RAW, 'k')} AS raw_type,
  CASE WHEN k % 5 = 0 THEN 'location' ELSE 'context' END AS raw_family, CASE WHEN k % 7 = 0 THEN 'undirected' ELSE '' END AS raw_directionality,
  a || ' and ' || b || {_sql_pick(_ADD, 'k')} AS fact, {_sql_pick(_TARGETS, 'doc_id')} AS target_type FROM fp)"""

_V = ", ".join(f"('{alias}', '{e[0]}', '{e[1]}', '{e[2]}', '{e[3]}', {'NULL' if e[4] is None else chr(39) + e[4] + chr(39)})" for e in R.SCHEMA for alias in [e[0], *e[5]])
S_CTE = f"reg(alias, t, rf, sf, dir, slot) AS (VALUES {_V})"


@query(
    "rel_01_registry",
    f"""WITH {F_CTE}, {S_CTE} SELECT doc_id, paragraph_index, coalesce(t, upper(trim(raw_type))) AS relation_type, coalesce(rf, 'context') AS relation_family,
coalesce(sf, 'context') AS state_family, coalesce(dir, 'undirected') AS directionality, slot AS state_slot FROM facts LEFT JOIN reg ON upper(trim(raw_type)) = alias""",
)
def rel_01(spark, sf_dir):
    return R.relation_entries(text_facts(spark, sf_dir), "raw_type").select("doc_id", "paragraph_index", "relation_type", "relation_family", "state_family", "directionality", "state_slot")


def _like(markers):
    return f"regexp_matches(lower(fact), '{'|'.join(markers)}')"


N_CTE = f"""{F_CTE}, {S_CTE},
en AS (SELECT facts.*, coalesce(t, upper(trim(raw_type))) AS t0, coalesce(rf, 'context') AS rf0, coalesce(sf, 'context') AS sf0, coalesce(dir, 'undirected') AS dir0, slot AS slot0
  FROM facts LEFT JOIN reg ON upper(trim(raw_type)) = alias),
ru AS (SELECT *, CASE WHEN t0 IN ('LOCATED_IN', 'OWNS') AND {_like(R.DISCOVERY)} THEN 1 WHEN t0 = 'LOCATED_IN' AND {_like(R.DEATH)} THEN 2 WHEN t0 = 'LOCATED_IN' AND {_like(R.DISPOSAL)} THEN 3
  WHEN t0 = 'MEMBER_OF' AND {_like(R.LEADERSHIP)} THEN 4 WHEN t0 = 'LOCATED_IN' AND target_type = 'artifact' THEN 5 ELSE 0 END AS rule FROM en),
nf AS (SELECT doc_id, chapter_index, paragraph_index, source, target, fact,
  CASE rule WHEN 1 THEN 'DISCOVERED' WHEN 2 THEN 'DIED_AT' WHEN 3 THEN 'BODY_DISPOSED_AT' WHEN 4 THEN 'LEADS_COMMUNITY' WHEN 5 THEN 'DISCOVERED' ELSE t0 END AS relation_type,
  CASE rule WHEN 0 THEN CASE WHEN raw_family = 'context' THEN sf0 ELSE raw_family END WHEN 4 THEN 'membership' ELSE 'context' END AS state_family,
  CASE rule WHEN 0 THEN coalesce(nullif(raw_directionality, ''), dir0) ELSE 'directed' END AS directionality,
  CASE rule WHEN 0 THEN slot0 END AS state_slot,
  CASE rule WHEN 0 THEN rf0 WHEN 4 THEN 'interpretive' ELSE 'eventive' END AS relation_family,
  CASE rule WHEN 1 THEN 'mapped_discovery_event_from_state_relation' WHEN 2 THEN 'mapped_death_event_from_location_relation' WHEN 3 THEN 'mapped_body_disposal_event_from_location_relation'
    WHEN 4 THEN 'mapped_leadership_relation_from_membership' WHEN 5 THEN 'artifact_target_not_valid_for_stable_location' ELSE '' END AS note FROM ru)"""


@query("rel_02_normalize_facts", f"WITH {N_CTE} SELECT doc_id, paragraph_index, relation_type, relation_family, state_family, directionality, state_slot, note FROM nf")
def rel_02(spark, sf_dir):
    return R.normalize_facts(text_facts(spark, sf_dir)).select("doc_id", "paragraph_index", "relation_type", "relation_family", "state_family", "directionality", "state_slot", "note")


_KEY = "CASE WHEN state_slot IS NULL THEN '' WHEN directionality = 'undirected' THEN state_slot || '|' || least(source, target) || '|' || greatest(source, target) ELSE state_slot || '|' || source END"
_SIG = "relation_type || '|' || state_family || '|' || CASE WHEN directionality = 'undirected' THEN least(source, target) || '|' || greatest(source, target) ELSE source || '|' || target END"


def _keys(df):
    args = [F.col("source"), F.col("target"), F.col("directionality")]
    return df.withColumn("state_key", R.state_key(F.col("state_slot"), *args)).withColumn("signature", R.signature(F.col("relation_type"), F.col("state_family"), *args))


@query("rel_03_state_key", f"WITH {N_CTE} SELECT doc_id, paragraph_index, {_KEY} AS state_key FROM nf")
def rel_03(spark, sf_dir):
    return _keys(R.normalize_facts(text_facts(spark, sf_dir))).select("doc_id", "paragraph_index", "state_key")


@query("rel_04_signature", f"WITH {N_CTE} SELECT doc_id, paragraph_index, {_SIG} AS signature FROM nf")
def rel_04(spark, sf_dir):
    return _keys(R.normalize_facts(text_facts(spark, sf_dir))).select("doc_id", "paragraph_index", "signature")


def star_facts(spark, sf_dir, asked="true"):
    directed = star_edges(spark, sf_dir, asked).withColumn("directionality", F.lit("directed")).withColumn("state_slot", F.lit("membership"))
    return _keys(directed)


ED_CTE = f"""{E_CTE},
ed AS (SELECT source, target, relation_type || '|' || state_family || '|' || source || '|' || target AS signature, 'membership|' || source AS state_key, count(*) AS weight,
  min((valid_at, l_orderkey, l_linenumber, l_suppkey, l_partkey)) AS f, max(confidence) AS confidence FROM e GROUP BY 1, 2, 3, 4),
sup AS (SELECT *, f[1] AS valid_at, lead(f[1]) OVER w AS invalid_at, lead(signature) OVER w AS invalidated_by FROM ed WINDOW w AS (PARTITION BY state_key ORDER BY f))"""


def star_relations(spark, sf_dir, asked="true"):
    """Edges of the star schema in reference mode, with their validity. asked: a condition on the customers (o_custkey) whose edges are wanted; others don't touch theirs."""
    return R.supersede(R.edges(star_facts(spark, sf_dir, asked), ORD)).withColumn("valid_at", F.col("first.valid_at"))


@query("rel_05_edges", f"WITH {ED_CTE} SELECT signature, weight, f[1] AS valid_at, confidence FROM ed")
def rel_05(spark, sf_dir):
    return R.edges(star_facts(spark, sf_dir), ORD).select("signature", "weight", F.col("first.valid_at").alias("valid_at"), "confidence")


@query("rel_06_scd2_versions", f"""WITH {E_CTE}, o AS (SELECT *, CASE WHEN lag(target) OVER w = target THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY source ORDER BY {ORD_SQL})),
r AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY {ORD_SQL}) AS run FROM o),
v AS (SELECT source, CAST(run AS BIGINT) AS version, any_value(target) AS target, count(*) AS weight, min(valid_at) AS valid_at FROM r GROUP BY 1, 2)
SELECT *, lead(valid_at) OVER (PARTITION BY source ORDER BY version) AS invalid_at FROM v""")
def rel_06(spark, sf_dir):
    return R.versions(star_facts(spark, sf_dir), ORD).select("source", F.col("run").alias("version"), "target", "weight", F.col("first.valid_at").alias("valid_at"), "invalid_at")


@query("rel_07_supersession", f"WITH {ED_CTE} SELECT signature, weight, valid_at, invalid_at, invalidated_by, CASE WHEN invalidated_by IS NULL THEN 'active' ELSE 'invalidated' END AS status FROM sup")
def rel_07(spark, sf_dir):
    return star_relations(spark, sf_dir).select("signature", "weight", "valid_at", "invalid_at", "invalidated_by", "status")


_FROM, _TO = "TIMESTAMP '1995-01-01'", "TIMESTAMP '1996-01-01'"


@query("rel_08_overlaps_window", f"WITH {ED_CTE} SELECT signature, valid_at, invalid_at FROM sup WHERE valid_at <= {_TO} AND coalesce(invalid_at, valid_at) >= {_FROM}")
def rel_08(spark, sf_dir):
    return star_relations(spark, sf_dir).where(f"valid_at <= {_TO} and coalesce(invalid_at, valid_at) >= {_FROM}").select("signature", "valid_at", "invalid_at")


@query(
    "rel_09_chapter_dedupe",
    f"""WITH {N_CTE}, k AS (SELECT *, {_SIG} AS signature FROM nf WHERE state_family IN ('location', 'membership', 'status', 'interaction', 'identity'))
SELECT chapter_index, signature, count(*) AS weight, string_agg(DISTINCT lpad(CAST(doc_id AS VARCHAR), 6, '0'), ',' ORDER BY lpad(CAST(doc_id AS VARCHAR), 6, '0')) AS docs, min(doc_id) AS first_doc FROM k GROUP BY 1, 2""",
)
def rel_09(spark, sf_dir):
    facts = _keys(R.normalize_facts(text_facts(spark, sf_dir))).where(F.col("state_family").isin("location", "membership", "status", "interaction", "identity"))
    docs = F.array_join(F.array_sort(F.collect_set(F.lpad(F.col("doc_id").cast("string"), 6, "0"))), ",")
    return facts.groupBy("chapter_index", "signature").agg(F.count("*").alias("weight"), docs.alias("docs"), F.min("doc_id").alias("first_doc"))


@query("rel_10_timelines", f"WITH {ED_CTE} SELECT signature, CAST(year(valid_at) AS BIGINT) AS validity_start, CAST(year(invalid_at) AS BIGINT) AS validity_end, datediff('day', valid_at, invalid_at) AS days_valid FROM sup")
def rel_10(spark, sf_dir):
    return star_relations(spark, sf_dir).select(
        "signature", F.year("valid_at").cast("long").alias("validity_start"), F.year("invalid_at").cast("long").alias("validity_end"), F.datediff("invalid_at", "valid_at").cast("long").alias("days_valid")
    )


_CAT = "CASE " + " ".join(f"WHEN regexp_matches(lower(relation_type || ' ' || fact), '{'|'.join(ws)}') THEN '{n}'" for n, ws in R.CATEGORIES) + " ELSE 'other' END"


@query("rel_11_category", f"WITH {N_CTE} SELECT doc_id, paragraph_index, {_CAT} AS category FROM nf")
def rel_11(spark, sf_dir):
    return R.normalize_facts(text_facts(spark, sf_dir)).select("doc_id", "paragraph_index", R.category(F.col("relation_type"), F.col("fact")).alias("category"))
