"""Answers (ANS) over conversations and retrieval hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import answers as A
from quillspark.operators import graph as G
from quillspark.operators import retrieval as R
from quillspark.plans.graphs import SPOILER_HINTS, TE_CTE, slugged, text_edges
from quillspark.plans.registry import query
from quillspark.plans.retrieval import RC, TH, book_lines, retrieval, text_hits
from quillspark.plans.views import P_CTE, paragraphs, sql_strip, table

_R3 = "floor(({}) * 1000 + 0.5) / 1000"


def _clip(x, n):
    c = rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE left({c}, {n - 1}) || '…' END"


@query("ans_01_citations", f"""WITH {RC}, {TH}, tt AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, paragraph_index) AS ord FROM th),
u AS (SELECT doc_id, paragraph_index, 0 AS part, ord, 'book_text' AS source_type, score FROM tt UNION ALL SELECT doc_id, paragraph_index, 1, rank, 'graph', score FROM rr),
fi AS (SELECT doc_id, paragraph_index, min((part, ord, source_type, score)) AS x FROM u GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY x[1], x[2], paragraph_index) AS rank FROM fi QUALIFY rank <= 10)
SELECT rk.doc_id, rank, rk.paragraph_index, x[3] AS source_type, x[4] AS score, {_clip('text', 180)} AS quote FROM rk JOIN p ON p.doc_id = rk.doc_id AND p.paragraph_index = rk.paragraph_index""")
def ans_01(spark, sf_dir):
    lines = book_lines(spark, sf_dir, stored=True)
    texts = paragraphs(spark, sf_dir).where("chapter_index <= 2").select("doc_id", "paragraph_index", "text")
    books = retrieval(spark, sf_dir, lines)
    contexts = books.each_book(lambda doc, lines, hits: [(*h, i) for i, h in enumerate(text_hits(lines), 1)], {"paragraph_index": "long", "score": "double", "ord": "long"})
    graph = books.reranked().select("doc_id", "paragraph_index", "score", F.col("rank").alias("ord"))
    return A.citations(contexts, graph, texts)


_MIX = "text || ' 山水人' || CASE WHEN turn % 2 = 0 THEN '这个心月' ELSE '' END"
_U = """list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(lower({0}), '[a-z0-9_]{{2,}}'), lambda x: x NOT IN ('the', 'and', 'this', 'that', 'with', 'from', 'current')),
  list_filter(list_concat(list_transform(range(1, length({1})), lambda i: substring({1}, i, 2)), list_transform(range(1, length({1}) - 1), lambda i: substring({1}, i, 3))), lambda x: x NOT IN ('这个', '那个', '因为', '所以', '但是', '他们', '我们', '自己', '当前', '文本', '问题')))))"""


def _units(x):
    return _U.format(x, f"regexp_replace(lower({x}), '[^一-鿿]', '', 'g')")


@query("ans_02_claim_units", f"SELECT conv_id, turn, array_to_string({_units('t')}, ' ') AS units FROM (SELECT conv_id, turn, {_MIX} AS t FROM conversations)")
def ans_02(spark, sf_dir):
    t = F.concat("text", F.lit(" 山水人"), F.when(F.col("turn") % 2 == 0, "这个心月").otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(A.claim_units(t), " ").alias("units"))


def _claims(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").groupBy("conv_id").agg(F.max("text").alias("evidence"))
    return A.claims(turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")).join(asked, "conv_id"), ["conv_id", "turn"])


_CL = f"""ev AS (SELECT conv_id, max(text) AS evidence FROM conversations WHERE role = 'user' GROUP BY 1),
an AS (SELECT c.conv_id, turn, {_units('evidence')} AS units, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?.\\n]*[。！？!?.]|[^。！？!?.\\n]+'), lambda x: regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda x: x <> '')[1:8] AS ss FROM conversations c JOIN ev ON ev.conv_id = c.conv_id WHERE role = 'assistant'),
cl0 AS (SELECT conv_id, turn, units, unnest(ss) AS claim, unnest(range(1, len(ss) + 1)) AS claim_index FROM an),
cl1 AS (SELECT *, regexp_replace(claim, '^[*#\\-—:： ]+|[*#\\-—:： ]+$', '', 'g') AS bare FROM cl0),
cl AS (SELECT conv_id, turn, claim_index, claim, len(list_intersect({_units('claim')}, units)) >= 2 OR regexp_matches(claim, '证据不足|无法判断|不足以判断') AS supported FROM cl1
  WHERE NOT (bare = '' OR (length(bare) <= 16 AND regexp_matches(claim, '\\*\\*|：|:')) OR regexp_matches(claim, '^\\s*(\\d+[.、]|[-*])\\s*.{{0,18}}$')))"""


@query("ans_03_claims", f"WITH {_CL} SELECT * FROM cl")
def ans_03(spark, sf_dir):
    return _claims(spark, sf_dir)


_CF = f"{_CL}, cf AS (SELECT conv_id, turn, count(*) AS n_claims, count(*) FILTER (NOT supported) AS n_unsupported FROM cl GROUP BY 1, 2)"


@query("ans_04_verified_answer", f"""WITH {_CF} SELECT conv_id, turn, n_claims, n_unsupported, {_R3.format('greatest(1.0::DOUBLE - n_unsupported / n_claims, CASE WHEN n_unsupported < n_claims THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END)')} AS confidence,
CASE WHEN n_unsupported = 0 THEN 'as_is' WHEN n_claims > n_unsupported AND n_unsupported > n_claims - n_unsupported THEN 'interpretive_note' WHEN n_claims > n_unsupported THEN 'needs_evidence_note' ELSE 'refused' END AS verdict FROM cf""")
def ans_04(spark, sf_dir):
    c = A.confidence(_claims(spark, sf_dir), ["conv_id", "turn"])
    return c.withColumn("verdict", A.verdict(F.col("n_unsupported"), F.col("n_claims")))


_TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_R4 = "floor(({}) * 10000 + 0.5) / 10000"


@query("ans_05_question_branches", f"""WITH {P_CTE}, q AS (SELECT conv_id, turn, conv_id AS doc_id, text, NOT regexp_matches(lower(text), '{'|'.join(SPOILER_HINTS)}') AS safe FROM conversations WHERE role = 'user'),
qt AS (SELECT conv_id, turn, doc_id, word, count(*) AS times FROM (SELECT conv_id, turn, doc_id, unnest({_TOK.format('text')}) AS word FROM q) GROUP BY ALL),
ws AS (SELECT doc_id, paragraph_index, {_TOK.format('text')} AS ws FROM p WHERE chapter_index <= 2), w AS (SELECT doc_id, paragraph_index, len(ws) AS n, unnest(list_distinct(ws)) AS word FROM ws),
h AS (SELECT conv_id, turn, paragraph_index, n, sum(times) AS hits FROM qt JOIN w ON w.doc_id = qt.doc_id AND w.word = qt.word GROUP BY ALL),
c AS (SELECT conv_id, turn, paragraph_index FROM (SELECT *, {_R4.format('hits / sqrt(n)')} AS score FROM h) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, paragraph_index) <= 5),
n AS (SELECT conv_id, turn, count(*) AS n FROM c GROUP BY ALL)
SELECT q.conv_id, q.turn, CASE WHEN NOT safe THEN 'spoiler_refusal' WHEN n IS NULL THEN 'no_context' ELSE 'answer' END AS branch, CASE WHEN NOT safe THEN 'question_requests_future_plot' WHEN n IS NULL THEN 'no_visible_context' ELSE 'ok' END AS reason,
coalesce(n, 0) AS n_contexts, CASE WHEN NOT safe THEN 1.0::DOUBLE WHEN n IS NULL THEN 0.0::DOUBLE END AS confidence FROM q LEFT JOIN n ON n.conv_id = q.conv_id AND n.turn = q.turn""")
def ans_05(spark, sf_dir):
    """Each conversation is about the book of its number, read to the end of chapter 2."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    asked = asked.select("conv_id", "turn", F.col("conv_id").alias("doc_id"), F.col("text").alias("question"), (~F.lower("text").rlike("|".join(SPOILER_HINTS))).alias("safe"))
    found = A.retrieve(asked, paragraphs(spark, sf_dir).where("chapter_index <= 2"), ["conv_id", "turn"])
    return A.question_branches(asked.select("conv_id", "turn", "safe"), found, ["conv_id", "turn"])


@query("ans_06_summary_inputs", f"""WITH {TE_CTE}, ep AS (SELECT DISTINCT doc_id, chapter_index, paragraph_index FROM m WHERE chapter_index <= 2),
rc AS (SELECT doc_id, c AS chapter_index, paragraph_index FROM ep, (SELECT unnest([1, 2]) AS c) WHERE ep.chapter_index <= c QUALIFY row_number() OVER (PARTITION BY doc_id, c ORDER BY paragraph_index DESC) <= 6),
fa AS (SELECT te.doc_id, rc.chapter_index, source, target, row_number() OVER (PARTITION BY te.doc_id, rc.chapter_index ORDER BY weight DESC, source, target) AS k FROM te JOIN rc ON rc.doc_id = te.doc_id AND rc.paragraph_index = valid_at),
ck AS (SELECT doc_id, chapter_index, text, row_number() OVER (PARTITION BY doc_id, chapter_index ORDER BY paragraph_index) AS k FROM p WHERE chapter_index <= 2),
u AS (SELECT doc_id, chapter_index, 0 AS part, k, 'chunk' AS kind, text FROM ck WHERE k <= 8 UNION ALL
  SELECT doc_id, chapter_index, 1, k, 'fact', '事实：' || source || ' --[SPOKE_WITH]--> ' || target || '：' || source || ' / ' || target FROM fa WHERE k <= 8 AND EXISTS (SELECT 1 FROM ck WHERE ck.doc_id = fa.doc_id AND ck.chapter_index = fa.chapter_index))
SELECT doc_id, chapter_index, row_number() OVER (PARTITION BY doc_id, chapter_index ORDER BY part, k) AS place, kind, text FROM u QUALIFY place <= 12""")
def ans_06(spark, sf_dir):
    """Inputs of the summaries of chapters 1 and 2, each as its reader would see it: facts are those of the last six episodes so far."""
    found = G.shared_table(slugged(spark, sf_dir, by_book=False), "names")
    eps = found.where("chapter_index <= 2").select("doc_id", "chapter_index", "paragraph_index").distinct()
    reader = eps.select("doc_id", "paragraph_index", F.explode(F.filter(F.array(F.lit(1), F.lit(2)), lambda c: c >= F.col("chapter_index"))).alias("chapter_index"))
    recent = R.top(reader, 6, F.desc("paragraph_index"), by=("doc_id", "chapter_index")).select("doc_id", "chapter_index", F.col("paragraph_index").alias("valid_at"))
    facts = R.top(text_edges(spark, sf_dir, found).join(recent, ["doc_id", "valid_at"]), 8, F.desc("weight"), F.col("source"), F.col("target"), by=("doc_id", "chapter_index"))
    facts = facts.withColumn("relation_type", F.lit("SPOKE_WITH")).withColumn("fact", F.concat_ws(" / ", "source", "target"))
    return A.summary_inputs(paragraphs(spark, sf_dir).where("chapter_index <= 2"), facts)


@query("ans_07_history", "SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn, role, text) AS history FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) <= 6) GROUP BY 1")
def ans_07(spark, sf_dir):
    last = A.history(table(spark, sf_dir, "conversations"), 6)
    line = F.concat("role", F.lit(":"), "text")
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))), lambda x: x["line"]), "|").alias("history"))


# Items as a model gives them: ids whole or without their beginning, anchors that don't stand there, blank remarks, kinds that don't exist.
_FULL_ID = "concat('d', doc_id, '-c001-p', paragraph_index)"
_ITEM = [
    f"CASE paragraph_index % 3 WHEN 0 THEN {_FULL_ID} WHEN 1 THEN concat('c001-p', paragraph_index) ELSE concat(' p', paragraph_index) END AS chunk_id",
    "CASE WHEN paragraph_index % 4 = 0 THEN 'zzzz' ELSE substring(text, 3, 12) END AS anchor_text",
    "CASE WHEN paragraph_index % 2 = 0 THEN substring(text, 1, 12) END AS label",
    "CASE WHEN paragraph_index % 5 = 0 THEN '  ' ELSE substring(text, 1, 80) END AS comment",
    "CASE paragraph_index % 3 WHEN 0 THEN 'theme' WHEN 1 THEN 'loud' END AS emphasis",
    "CASE paragraph_index % 4 WHEN 1 THEN 'question' WHEN 2 THEN 'angry' END AS bubble_type",
]


@query("ans_08_bubbles", f"""WITH {P_CTE}, c1 AS (SELECT * FROM p WHERE chapter_index = 1 AND (doc_id % 3 <> 0 OR paragraph_index = 2)), c AS (SELECT doc_id, paragraph_index AS ord, {_FULL_ID} AS chunk_id, text FROM c1),
nv AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1), i0 AS (SELECT doc_id, paragraph_index AS i, {', '.join(_ITEM)} FROM p WHERE chapter_index = 1),
i1 AS (SELECT i0.*, n, row_number() OVER (PARTITION BY i0.doc_id ORDER BY i) AS place FROM i0 JOIN nv ON nv.doc_id = i0.doc_id QUALIFY place <= CASE WHEN n = 1 THEN 5 ELSE 3 END),
i2 AS (SELECT *, {sql_strip('chunk_id')} AS asked, {sql_strip('anchor_text')} AS anchor, {sql_strip('comment')}[1:60] AS remark, {sql_strip("coalesce(label, '')")}[1:8] AS lab, {sql_strip("coalesce(emphasis, 'detail')")} AS emph FROM i1),
i3 AS (SELECT i2.*, (SELECT min(((c.chunk_id <> asked)::INT, c.ord, c.text)) FROM c WHERE c.doc_id = i2.doc_id AND ends_with(c.chunk_id, asked)) AS m FROM i2 WHERE asked <> ''),
i4 AS (SELECT *, coalesce(bubble_type, emph) AS kind FROM i3 WHERE m IS NOT NULL AND anchor <> '' AND contains(m[3], anchor) AND remark <> '')
SELECT doc_id, 'bubble-' || asked || '-' || place AS bubble_id, asked AS chunk_id, anchor AS anchor_text, CASE WHEN lab = '' THEN '{A.NO_LABEL}' ELSE lab END AS label, remark AS comment,
CASE WHEN emph IN ('{"', '".join(A.EMPHASES)}') THEN emph ELSE 'detail' END AS emphasis, CASE WHEN kind IN ('{"', '".join(A.BUBBLE_TYPES)}') THEN kind ELSE 'detail' END AS bubble_type,
CASE WHEN n = 1 THEN 'selected-passage' ELSE 'page-salience-policy' END AS trigger_reason FROM i4""")
def ans_08(spark, sf_dir):
    """A reader sees chapter 1, or of every third book one paragraph of it."""
    first = paragraphs(spark, sf_dir).where("chapter_index = 1")
    chunks = first.where("doc_id % 3 <> 0 or paragraph_index = 2").selectExpr("doc_id", "paragraph_index as ord", f"{_FULL_ID} as chunk_id", "text")
    items = first.selectExpr("doc_id", "paragraph_index as i", *_ITEM)
    return A.inline_bubbles(items, chunks)
