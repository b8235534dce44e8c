"""Sources (SRC), persona knowledge (PKB), registry (REG) and streaming state (STR) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import persona as P
from quillspark.operators import relations as Rel
from quillspark.plans.registry import query
from quillspark.plans.relations import star_facts
from quillspark.plans.views import E_CTE, ORD, P_CTE, paragraphs, table
from quillspark.sources import readers, stores
from quillspark.streaming import incremental as S


@query("src_07_list_books", "SELECT DISTINCT 'book-' || source AS book_id, source AS title FROM documents")
def src_07(spark, sf_dir):
    books = table(spark, sf_dir, "documents").select(F.concat(F.lit("book-"), "source").alias("book_id"), F.col("source").alias("title"))
    return stores.list_books(books)


@query("src_08_graph_metadata", f"WITH {P_CTE} SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'paragraphs', count(*) FROM p")
def src_08(spark, sf_dir):
    return stores.graph_metadata({"documents": table(spark, sf_dir, "documents"), "paragraphs": paragraphs(spark, sf_dir)})


@query("src_11_json_lines", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 10 <> 0")
def src_11(spark, sf_dir):
    """Lines of which every tenth is broken; the broken ones are left out."""
    lines = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id", "props"))).alias("value"))
    rows = lines.select(F.from_json("value", "event_id long, props string, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("x")).select("x.*").where("_bad is null")
    return rows.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("src_12_build_log", "SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def src_12(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("src_13_held_out_essays", r"SELECT doc_id, CAST(length(regexp_replace(text, '[\s\p{Z}]', '', 'g')) AS BIGINT) AS char_count FROM documents WHERE source NOT IN ('src0', 'src1') AND length(regexp_replace(text, '[\s\p{Z}]', '', 'g')) >= 400")
def src_13(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), "text")
    excluded = d.where("title in ('src0', 'src1')").select("title").distinct()
    return readers.held_out_essays(d, excluded).select("doc_id", "char_count")


@query("src_14_page_links", """SELECT page_id, CAST(len(ls) AS BIGINT) AS n_links, coalesce(ls[1], '') AS first_link FROM (SELECT page_id, regexp_extract_all(html, '<a\\s+[^>]*href="([^"#]+)', 1) AS ls FROM pages)""")
def src_14(spark, sf_dir):
    links = readers.page_links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.coalesce(F.get(links, 0), F.lit("")).alias("first_link"))


_KIND = "CASE doc_id % 3 WHEN 0 THEN 'work' WHEN 1 THEN 'voice' ELSE 'biography' END"


def _catalog(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("persona"), F.expr(_KIND).alias("kind"), F.col("source").alias("title"), F.col("doc_id").alias("ord"))


@query("pkb_01_source_documents", f"SELECT persona, kind, title, persona || ':' || kind || ':' || title || ':' || ord AS source_id, CAST(CASE kind WHEN 'work' THEN 1 WHEN 'voice' THEN 2 ELSE 3 END AS BIGINT) AS priority FROM (SELECT lang AS persona, {_KIND} AS kind, source AS title, doc_id AS ord FROM documents)")
def pkb_01(spark, sf_dir):
    return P.source_documents(_catalog(spark, sf_dir))


@query("pkb_02_snippets", """WITH s AS (SELECT doc_id, unnest(['bio', 'era', 'style', 'boundary']) AS kind, unnest([text, lang, nullif(source, 'src3'), 'no ' || lang]) AS text FROM documents
UNION ALL SELECT doc_id, 'theme', unnest(list_value(lang || '-a', source)) FROM documents)
SELECT doc_id AS persona, kind, text, CASE kind WHEN 'bio' THEN 0.9::DOUBLE WHEN 'era' THEN 0.7::DOUBLE WHEN 'style' THEN 1.0::DOUBLE WHEN 'boundary' THEN 0.8::DOUBLE ELSE 1.1::DOUBLE END AS weight FROM s WHERE text IS NOT NULL AND text <> ''""")
def pkb_02(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    profiles = d.select(F.col("doc_id").alias("persona"), F.col("text").alias("bio"), F.col("lang").alias("era"), F.nullif("source", F.lit("src3")).alias("style"), F.concat(F.lit("no "), "lang").alias("boundary"), F.array(F.concat("lang", F.lit("-a")), F.col("source")).alias("themes"))
    return P.snippets(profiles)


@query("pkb_03_manifest", f"SELECT lang AS persona, count(*) FILTER (k = 'work') AS work, count(*) FILTER (k = 'voice') AS voice, count(*) FILTER (k = 'biography') AS biography FROM (SELECT lang, {_KIND} AS k FROM documents) GROUP BY 1")
def pkb_03(spark, sf_dir):
    kinds = ["work", "voice", "biography"]
    return _catalog(spark, sf_dir).groupBy("persona").pivot("kind", kinds).agg(F.count(F.lit(1))).fillna(0, kinds)


@query("pkb_04_alias_resolution", "SELECT doc_id, CASE lang WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' ELSE lang END AS agent, lang IN ('fr', 'de') AS ready FROM documents")
def pkb_04(spark, sf_dir):
    names = spark.createDataFrame([("fr", "french"), ("de", "german")], "alias string, agent string")
    d = table(spark, sf_dir, "documents").join(F.broadcast(names), F.col("lang") == F.col("alias"), "left")  # two rows
    return d.select("doc_id", F.coalesce("agent", "lang").alias("agent"), F.col("agent").isNotNull().alias("ready"))


@query("reg_01_normalized_records", "SELECT doc_id, 'public' AS licence, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'xx' END AS lang, coalesce(nullif(trim(CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE source END), ''), 'unknown') AS source FROM documents")
def reg_01(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("string").alias("licence"), F.when(F.col("lang").isin("en", "de"), F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.col("source")).alias("source"))
    return P.normalized_records(raw, {"licence": "restricted", "lang": "xx", "source": "unknown"}, {"licence": "public"}, {"lang": ["en", "de", "xx"]})


@query("reg_02_text_stats", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, CAST(greatest(1, len(regexp_extract_all(text, '(?im)^\\s*chapter[\\s_-]*\\d+'))) AS BIGINT) AS chapters FROM documents")
def reg_02(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *P.text_stats(F.col("text")))


@query("str_01_incremental_state", f"WITH {P_CTE} SELECT doc_id, count(*) AS n_chunks, max(chapter_index) AS last_chapter, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM p GROUP BY 1")
def str_01(spark, sf_dir):
    """What an incremental build keeps for each book, however its chunks came: repeats count once."""
    p = paragraphs(spark, sf_dir)
    replay = p.unionByName(p.where("paragraph_index % 5 = 0")).dropDuplicates(["doc_id", "paragraph_index"])
    return book_state(replay)


def book_state(chunks):
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("chapter_index").alias("last_chapter"), F.sum(F.length("text")).alias("n_chars"))


@query("str_02_job_state", "SELECT user_id AS job, max_by(event_type, (ts, event_id)) AS stage, max_by(value, (ts, event_id)) AS value, count(*) AS n_events FROM events GROUP BY 1")
def str_02(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "ts", "event_id", F.col("event_type").alias("stage"), "value")
    return S.latest_state(e, "job", ["ts", "event_id"], ["stage", "value"])


@query("str_03_windows", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY 1, 2")
def str_03(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return S.tumbling_counts(e).withColumn("total", F.floor(F.col("total") * 100 + 0.5) / 100)


@query("str_04_out_of_order", f"WITH {E_CTE}, o AS (SELECT *, CASE WHEN lag(target) OVER w = target THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY source ORDER BY valid_at, l_orderkey, l_linenumber, l_suppkey, l_partkey)) SELECT source, CAST(sum(opens) AS BIGINT) AS n_versions FROM o GROUP BY 1")
def str_04(spark, sf_dir):
    """Facts that arrive in any order give the versions of their valid time."""
    facts = star_facts(spark, sf_dir)
    late = facts.where("l_linenumber % 2 = 0").unionByName(facts.where("l_linenumber % 2 = 1"))
    return Rel.versions(late, ORD).groupBy("source").agg(F.count("*").alias("n_versions"))


@query("str_05_reading_sessions", """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def str_05(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return S.sessions(e, "user_id", "6 hours")


