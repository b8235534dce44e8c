"""Evaluation (EVL) and stylometry (STY) over labels, conversations, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import evaluation as E
from quillspark.operators import graph as G
from quillspark.plans.graphs import SPOILER_HINTS
from quillspark.plans.registry import query
from quillspark.plans.segmentation import _BLOCKS
from quillspark.plans.views import P_CTE, paragraphs, spread, table

_R4 = "floor(({}) * 10000 + 0.5) / 10000"
_R3 = "floor(({}) * 1000 + 0.5) / 1000"

_RULES = {"event_type": {"required": True, "enum": ["click", "view", "purchase"]}, "user_id": {"type": "integer", "minimum": 10, "maximum": 120}, "value": {"minimum": 5.0}}


@query("evl_01_schema_errors", """SELECT event_id, CAST(CASE WHEN event_type IS NULL OR event_type NOT IN ('click', 'view', 'purchase') THEN 1 ELSE 0 END + CASE WHEN user_id < 10 THEN 2 ELSE 0 END + CASE WHEN user_id > 120 THEN 2 ELSE 0 END + CASE WHEN value < 5.0 THEN 1 ELSE 0 END AS BIGINT) AS n_errors,
coalesce(CASE WHEN user_id < 10 THEN '$.user_id: expected >= 10' WHEN user_id > 120 THEN '$.user_id: expected <= 120' END, '') AS bound_error FROM events""")
def evl_01(spark, sf_dir):
    errors = E.violations(_RULES)
    bound = F.coalesce(F.get(F.filter(errors, lambda x: F.startswith(x, F.lit("$.user_id"))), 0), F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", F.size(errors).cast("long").alias("n_errors"), bound.alias("bound_error"))


@query("evl_02_highlight_support", f"""WITH {P_CTE}, g AS (SELECT doc_id, list(paragraph_index) FILTER (paragraph_index <= 3) AS gold, list(paragraph_index) FILTER (paragraph_index % 2 = 1 OR doc_id % 2 = 0) AS got, min_by(text, paragraph_index) AS answer FROM p GROUP BY 1)
SELECT doc_id, doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND CASE WHEN doc_id % 5 = 0 THEN '' ELSE answer END <> '' AND len(list_filter(gold, lambda x: NOT list_contains(coalesce(got, []), x))) = 0 AS passed FROM g""")
def evl_02(spark, sf_dir):
    """A book's first three paragraphs as gold; some samples break the schema, some answers are refused or blank."""
    pick = lambda c: F.collect_list(F.when(c, F.col("paragraph_index")))
    g = paragraphs(spark, sf_dir).groupBy("doc_id").agg(pick(F.col("paragraph_index") <= 3).alias("gold"), pick((F.col("paragraph_index") % 2 == 1) | (F.col("doc_id") % 2 == 0)).alias("got"), F.min_by("text", "paragraph_index").alias("answer"))
    errors = F.when(F.col("doc_id") % 11 == 0, F.array(F.lit("$.x: missing required field"))).otherwise(F.array().cast("array<string>"))
    answer = F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("answer"))
    return g.select("doc_id", E.highlight_met(errors, F.col("doc_id") % 7 != 0, answer, F.col("gold"), F.col("got")).alias("passed"))


_EXPECTED = ("refuse_future_plot", "answer_within_boundary", "acknowledge_uncertainty", "reflect_on_known_text_only", "praise_the_author")
_HINTS = "|".join(SPOILER_HINTS)


@query("evl_03_anti_spoiler", f"""WITH s AS (SELECT conv_id, turn, ['{"', '".join(_EXPECTED)}'][(conv_id + turn) % 5 + 1] AS expected, NOT regexp_matches(lower(text), '{_HINTS}') AS safe,
  CASE WHEN turn % 3 = 2 THEN '  ' ELSE text END AS answer FROM conversations)
SELECT conv_id, turn, CASE WHEN expected = 'refuse_future_plot' THEN NOT safe WHEN expected = 'praise_the_author' THEN false ELSE safe AND regexp_replace(answer, '[\\s\\p{{Z}}]+', '', 'g') <> '' END AS passed FROM s""")
def evl_03(spark, sf_dir):
    """Each turn as a sample: its question is safe or not, every third answer is blank, one expectation in five is none that is known."""
    safe = ~F.lower("text").rlike(_HINTS)
    expected = F.get(F.array(*map(F.lit, _EXPECTED)), ((F.col("conv_id") + F.col("turn")) % 5).cast("int"))
    reason = F.when(safe, "ok").otherwise("question_requests_future_plot")
    met = E.anti_spoiler_met(expected, safe, reason, F.when(F.col("turn") % 3 == 2, "  ").otherwise(F.col("text")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", met.alias("passed"))


@query("evl_04_summary_phrases", """WITH x AS (SELECT doc_id, text, ['The', 'of', source] AS expected, ['idiot', 'Of the', lang] AS forbidden FROM documents),
y AS (SELECT doc_id, list_filter(expected, lambda e: NOT contains(text, e)) AS missing, list_filter(forbidden, lambda f: contains(text, f)) AS leaked FROM x)
SELECT doc_id, array_to_string(missing, ',') AS missing, array_to_string(leaked, ',') AS leaked, len(missing) = 0 AND len(leaked) = 0 AS passed FROM y""")
def evl_04(spark, sf_dir):
    expected, forbidden = F.array(F.lit("The"), F.lit("of"), F.col("source")), F.array(F.lit("idiot"), F.lit("Of the"), F.col("lang"))
    missing, leaked, passed = E.phrases(F.col("text"), expected, forbidden)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(missing, ",").alias("missing"), F.array_join(leaked, ",").alias("leaked"), passed.alias("passed"))


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "labels").select((F.col("doc_id") % 3).alias("arm"), F.col("doc_id").alias("item"), F.col("quality").cast("double").alias("a"), F.col("toxic").cast("double").alias("b"))


@query("evl_05_paired_bootstrap")
def evl_05(spark, sf_dir):
    return E.paired_tests(_pairs(spark, sf_dir), ["arm"]).select("arm", "n", T.round4(F.col("diff")).alias("diff"), T.round4(F.col("ci_low")).alias("ci_low"), T.round4(F.col("ci_high")).alias("ci_high"))


@query("evl_06_paired_permutation")
def evl_06(spark, sf_dir):
    return E.paired_tests(_pairs(spark, sf_dir), ["arm"]).select("arm", "n", T.round4(F.col("diff")).alias("diff"), T.round4(F.col("p_value")).alias("p_value"))


_COND = ["neutral", "style_only", "thinking_only", "full", "wrong_persona"]


@query("evl_07_factorial_effects", f"""WITH s AS (SELECT user_id % 2 AS persona, event_id // 5 AS item, event_id % 5 AS c, value FROM events),
w AS (SELECT persona, item, max(value) FILTER (c = 0) AS n, max(value) FILTER (c = 1) AS s, max(value) FILTER (c = 2) AS t, max(value) FILTER (c = 3) AS f, max(value) FILTER (c = 4) AS x FROM s GROUP BY 1, 2)
SELECT persona, count(*) AS n_items, {_R4.format('avg((f + t) / 2 - (n + s) / 2)')} AS thinking, {_R4.format('avg((s + f) / 2 - (n + t) / 2)')} AS style, {_R4.format('avg(f - x)')} AS full_vs_wrong
FROM w WHERE n IS NOT NULL AND s IS NOT NULL AND t IS NOT NULL AND f IS NOT NULL GROUP BY GROUPING SETS ((persona), ())""")
def evl_07(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 2).alias("persona"), F.floor(F.col("event_id") / 5).alias("item"), F.get(F.array(*map(F.lit, _COND)), (F.col("event_id") % 5).cast("int")).alias("condition"), "value")
    w = rows.groupBy("persona", "item").pivot("condition", _COND).agg(F.max("value")).where("neutral is not null and style_only is not null and thinking_only is not null and full is not null")
    think = F.expr("avg((full + thinking_only) / 2 - (neutral + style_only) / 2)")
    style = F.expr("avg((style_only + full) / 2 - (neutral + thinking_only) / 2)")
    return w.groupingSets([[F.col("persona")], []], "persona").agg(F.count("*").alias("n_items"), T.round4(think).alias("thinking"), T.round4(style).alias("style"), T.round4(F.avg(F.col("full") - F.col("wrong_persona"))).alias("full_vs_wrong"))


@query("evl_08_judge_agreement", f"""WITH s AS (SELECT doc_id AS item, doc_id % 4 AS condition, 'quality' AS judge, quality AS score FROM labels UNION ALL SELECT doc_id, doc_id % 4, 'toxic', toxic FROM labels UNION ALL SELECT doc_id, doc_id % 4, 'constant', 1 FROM labels)
SELECT a.judge, b.judge AS other, count(*) AS n, {_R4.format('avg(CASE WHEN a.score = b.score THEN 1 ELSE 0 END)')} AS exact, {_R4.format('avg(CASE WHEN abs(a.score - b.score) <= 1 THEN 1 ELSE 0 END)')} AS within_one,
CASE WHEN var_pop(a.score) > 0 AND var_pop(b.score) > 0 THEN {_R4.format('covar_pop(a.score, b.score) / sqrt(var_pop(a.score) * var_pop(b.score))')} END AS pearson
FROM s a JOIN s b ON a.item = b.item AND a.condition = b.condition AND a.judge < b.judge GROUP BY 1, 2""")
def evl_08(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), (F.col("doc_id") % 4).alias("condition"), F.expr("stack(3, 'quality', quality, 'toxic', toxic, 'constant', 1) as (judge, score)"))
    return E.agreement(rows)


@query("evl_09_blind_tasks", "WITH t AS (SELECT doc_id, substring(sha256('p|' || doc_id || '|' || source || '|full'), 1, 16) AS task_id FROM documents) SELECT task_id, doc_id, substring(sha256('7|' || task_id), 1, 16) AS shuffle_key FROM t")
def evl_09(spark, sf_dir):
    task = F.substring(F.sha2(F.concat_ws("|", F.lit("p"), "doc_id", "source", F.lit("full")), 256), 1, 16)
    t = table(spark, sf_dir, "documents").select(task.alias("task_id"), "doc_id")
    # sorting by a seeded hash is the seeded shuffle; as a key it needs no task that sees all rows
    return t.withColumn("shuffle_key", F.substring(F.sha2(F.concat(F.lit("7|"), "task_id"), 256), 1, 16))


_MCQ = f"""v0 AS (SELECT user_id % 40 AS item, ['{"', '".join(_COND)}'][event_id % 5 + 1] AS condition, event_id AS run, CASE WHEN event_id % 7 <> 3 THEN event_type END AS choice, ['click', 'view', 'purchase'][user_id % 3 + 1] AS correct FROM events),
vn AS (SELECT item, condition, correct, count(choice) AS n_valid, count(*) FILTER (choice = correct) AS n_correct FROM v0 GROUP BY 1, 2, 3),
ve AS (SELECT item, correct, condition, choice, count(*) AS n, min(run) AS first FROM v0 WHERE choice IS NOT NULL GROUP BY 1, 2, 3, 4),
vm AS (SELECT item, correct, condition, max_by(choice, (n, -first)) AS majority FROM ve GROUP BY 1, 2, 3),
mi AS (SELECT vn.item, vn.condition, vn.correct, n_valid, {_R3.format('CASE WHEN n_valid > 0 THEN n_correct / n_valid END')} AS acc, majority, coalesce(majority = vn.correct, false) AS majority_correct FROM vn LEFT JOIN vm ON vm.item = vn.item AND vm.correct = vn.correct AND vm.condition = vn.condition)"""


def _mcq(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 40).alias("item"), F.get(F.array(*map(F.lit, _COND)), (F.col("event_id") % 5).cast("int")).alias("condition"), F.col("event_id").alias("run"),
        F.when(F.col("event_id") % 7 != 3, F.col("event_type")).alias("choice"), F.get(F.array(*map(F.lit, ("click", "view", "purchase"))), (F.col("user_id") % 3).cast("int")).alias("correct"),
    )


@query("evl_10_mcq_majority", f"WITH {_MCQ} SELECT item, correct, condition, n_valid, acc, majority, majority_correct FROM mi")
def evl_10(spark, sf_dir):
    """Events as votes on the items of their users, some of them void."""
    return E.mcq_items(_mcq(spark, sf_dir), ["item", "correct"])


@query("evl_10_mcq_summary", f"""WITH {_MCQ}, d AS (SELECT item, correct FROM mi WHERE condition = 'neutral' AND NOT majority_correct), x AS (SELECT mi.*, d.item IS NOT NULL AS special FROM mi LEFT JOIN d ON d.item = mi.item AND d.correct = mi.correct)
SELECT condition, count(*) AS n_items, count(*) FILTER (special) AS n_distinctive, {_R3.format('avg(acc)')} AS acc_all_soft, {_R3.format('avg(majority_correct::INT)')} AS acc_all_majority, {_R3.format('avg(majority_correct::INT) FILTER (special)')} AS acc_distinctive_majority FROM x GROUP BY 1""")
def evl_10_summary(spark, sf_dir):
    return E.mcq_summary(E.mcq_items(_mcq(spark, sf_dir), ["item", "correct"]), ["item", "correct"])


@query("evl_11_continuation_scores", f"""WITH s AS (SELECT user_id % 5 AS condition, CASE WHEN event_id % 2 = 0 THEN 'first' ELSE 'second' END AS judge, CASE WHEN value > 20 THEN least(2, floor(value / 25)) END AS score FROM events)
SELECT condition, judge, count(*) AS n_items, count(score) AS n_scored, {_R3.format('avg(score)')} AS mean_score FROM s GROUP BY 1, 2""")
def evl_11(spark, sf_dir):
    judge = F.when(F.col("event_id") % 2 == 0, "first").otherwise("second")
    score = F.when(F.col("value") > 20, F.least(F.lit(2), F.floor(F.col("value") / 25)))
    return E.continuation_means(table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("condition"), judge.alias("judge"), F.col("event_id").alias("item"), score.alias("score")))


_MEANS = ", ".join(f"avg(value) FILTER (event_id % 5 = {k}) AS {c}" for k, c in enumerate(_COND[:4]))


@query("evl_12_report", f"""WITH m AS (SELECT user_id AS persona, event_type, {_MEANS} FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
t AS (SELECT * FROM m WHERE event_type = 'click'), s AS (SELECT * FROM m WHERE event_type = 'view'),
v AS (SELECT coalesce(t.persona, s.persona) AS persona, coalesce(s."full" > s.neutral AND s.style_only > s.neutral, false) AS style_tracks_style,
  abs(s.thinking_only - s.neutral) < abs(s.style_only - s.neutral) / 2 + 1e-9 AS style_flat_on_thinking,
  coalesce(t."full" > t.neutral AND t.thinking_only > t.neutral, false) AS thinking_tracks_thinking, abs(t.style_only - t.neutral) < abs(t."full" - t.neutral) / 2 + 1e-9 AS thinking_flat_on_style
  FROM t FULL JOIN s ON t.persona = s.persona)
SELECT *, coalesce(style_tracks_style AND thinking_tracks_thinking AND style_flat_on_thinking AND thinking_flat_on_style, false) AS double_dissociation FROM v""")
def evl_12(spark, sf_dir):
    """Users as personas: clicks measure thinking, views style; an event's number gives its condition."""
    rows = table(spark, sf_dir, "events").where("event_type in ('click', 'view')")
    axis = F.when(F.col("event_type") == "click", "thinking").otherwise("style")
    means = [F.avg(F.when(F.col("event_id") % 5 == k, F.col("value"))).alias(c) for k, c in enumerate(_COND[:4])]
    return E.dissociation(rows.groupBy(F.col("user_id").alias("persona"), axis.alias("axis")).agg(*means), "persona")


# Anchors as a model gives them: as they stand, with other marks between the words, too short without their marks, and from elsewhere.
_ANCHOR = """CASE paragraph_index % 4 WHEN 0 THEN substring(text, 40, 14) WHEN 1 THEN replace(substring(text, 30, 16), ' ', '--') WHEN 2 THEN replace(substring(text, 50, 5), ' ', '..') ELSE 'zzzz qqqq' END"""
_NZ = r"[^\p{L}\p{N}]"


@query("evl_13_span_location", rf"""WITH {P_CTE}, q AS (SELECT doc_id, paragraph_index, replace(text, '. ', '。') AS text FROM p), x AS (SELECT *, {_ANCHOR} AS anchor FROM q WHERE length(text) >= 60),
n AS (SELECT *, instr(text, anchor) - 1 AS exact, regexp_replace(anchor, '{_NZ}', '', 'g') AS bare, instr(regexp_replace(text, '{_NZ}', '', 'g'), regexp_replace(anchor, '{_NZ}', '', 'g')) AS among FROM x),
k AS (SELECT doc_id, paragraph_index, i - 1 AS raw, row_number() OVER (PARTITION BY doc_id, paragraph_index ORDER BY i) AS nth FROM (SELECT doc_id, paragraph_index, text, unnest(range(1, length(text) + 1)) AS i FROM n) WHERE regexp_matches(substring(text, i, 1), '[\p{{L}}\p{{N}}]')),
a AS (SELECT n.*, CASE WHEN exact >= 0 THEN exact WHEN length(bare) >= 5 AND among > 0 THEN raw ELSE -1 END AS pos FROM n LEFT JOIN k ON k.doc_id = n.doc_id AND k.paragraph_index = n.paragraph_index AND nth = among),
l AS (SELECT *, greatest(0, pos - 260) AS lo, least(length(text), pos + 220) AS hi FROM a WHERE pos >= 0),
f AS (SELECT *, length(regexp_extract(substring(text, lo + 1, pos - lo), '^[^。！？”』」
]*[。！？”』」
]')) AS first, length(regexp_extract(substring(text, hi + 1), '^[^。！？”』」]*[。！？”』」]')) AS nxt FROM l)
SELECT doc_id, paragraph_index, CAST(pos AS BIGINT) AS anchor_at, CAST(CASE WHEN lo = 0 THEN 0 WHEN first > 0 THEN lo + first ELSE lo END AS BIGINT) AS setup_at, CAST(least(CASE WHEN nxt > 0 THEN hi + nxt ELSE length(text) END, pos + 300) AS BIGINT) AS end_at FROM f""")
def evl_13(spark, sf_dir):
    rows = paragraphs(spark, sf_dir).select("doc_id", "paragraph_index", F.replace("text", F.lit(". "), F.lit("。")).alias("text")).where(F.length("text") >= 60)
    found = rows.withColumn("anchor", F.expr(_ANCHOR)).withColumn("anchor_at", E.anchor_at(F.col("anchor"), F.col("text"))).where("anchor_at >= 0")
    setup, end = E.setup_start(F.col("text"), F.col("anchor_at")), E.passage_end(F.col("text"), F.col("anchor_at"))
    return found.select("doc_id", "paragraph_index", F.col("anchor_at").cast("long").alias("anchor_at"), setup.cast("long").alias("setup_at"), end.cast("long").alias("end_at"))


@query("evl_14_evidence", r"""WITH n AS (SELECT item_id, regexp_replace(CASE WHEN item_id % 5 = 0 THEN substring(text, 1, 1 + item_id % 9) ELSE text END, '[^\p{L}\p{N}]', '', 'g') AS needle FROM benchmark)
SELECT item_id, count(*) AS n_docs FROM n JOIN documents d ON length(needle) >= 4 AND contains(regexp_replace(d.text, '[^\p{L}\p{N}]', '', 'g'), needle) GROUP BY 1""")
def evl_14(spark, sf_dir):
    """Benchmark passages as evidence, every fifth cut to a few characters; fewer than four prove nothing."""
    quote = F.when(F.col("item_id") % 5 == 0, F.substring(F.col("text"), F.lit(1), (1 + F.col("item_id") % 9).cast("int"))).otherwise(F.col("text"))
    items = table(spark, sf_dir, "benchmark").select("item_id", E.normalized(quote).alias("needle"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", E.normalized("text").alias("bare"))
    return E.verify_evidence(docs, items, least=4)


@query("evl_15_patch", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'edited' ELSE source END AS source FROM documents WHERE doc_id % 7 <> 0")
def evl_15(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return E.patched(d, "doc_id", d.where("doc_id % 7 = 0"), d.where("doc_id % 5 = 0").select("doc_id", F.lit("edited").alias("source")), "source")


@query("evl_16_cache_keys", "SELECT conv_id, turn, substring(sha256('{\"role\":\"' || role || '\",\"turn\":' || turn || '}'), 1, 20) AS cache_key FROM conversations")
def evl_16(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring(F.sha2(F.to_json(F.struct("role", "turn")), 256), 1, 20).alias("cache_key"))


_FEATURES = ["the", "of", "and", "la", "de", "der", "die", "que", "en", "and"]  # one twice, as it may be in a list
_DISTINCT = list(dict.fromkeys(_FEATURES))
_FT = "ft(feature, times) AS (VALUES " + ", ".join(f"('{f}', {_FEATURES.count(f)})" for f in _DISTINCT) + ")"
_FREQ = "(length({0}) - length(replace({0}, feature, ''))) / length(feature) * 1000.0::DOUBLE / greatest(1, length({0}))"


def _frequency(c, feature):
    return (F.length(c) - F.length(F.replace(F.col(c), F.lit(feature), F.lit("")))) / len(feature) * 1000.0 / F.greatest(F.lit(1), F.length(c))


def _block_frequencies(spark, sf_dir):
    """(doc_id, lang, pos, f0, f1, ...): a column for each feature, all from one look at a block."""
    b = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", F.posexplode(T.blocks_of("text")).alias("pos", "block"))
    return b.select("doc_id", "lang", "pos", *[_frequency("block", f).alias(f"f{k}") for k, f in enumerate(_DISTINCT)])


@query("sty_01_feature_frequency", rf"WITH {_FT}, d AS (SELECT doc_id, regexp_replace(text, '[\s\p{{Z}}]', '', 'g') AS t FROM documents) SELECT doc_id, feature, {_R4.format(_FREQ.format('t'))} AS per_1000 FROM d, ft")
def sty_01(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"(?U)\s", "").alias("t"))
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), T.round4(_frequency("t", f)).alias("per_1000")) for f in _DISTINCT])
    return d.select("doc_id", F.inline(pairs))


_PROF = f"{_BLOCKS}, {_FT}, bf AS (SELECT blocks.doc_id, lang, block_index, feature, times, {_FREQ.format('block')} AS f FROM blocks JOIN documents ON documents.doc_id = blocks.doc_id, ft), pr AS (SELECT lang, feature, avg(f) AS mu, stddev_pop(f) AS sd FROM bf GROUP BY 1, 2)"


def _profile(blocks):
    """One row a language: mu0, sd0, mu1, sd1, ..."""
    stats = [(F.avg(f"f{k}").alias(f"mu{k}"), F.stddev_pop(f"f{k}").alias(f"sd{k}")) for k in range(len(_DISTINCT))]
    return blocks.groupBy("lang").agg(*[c for pair in stats for c in pair])


@query("sty_02_author_profile", f"WITH {_PROF} SELECT lang, feature, {_R4.format('mu')} AS mu, {_R4.format('sd')} AS sd FROM pr")
def sty_02(spark, sf_dir):
    rows = [F.struct(F.lit(f).alias("feature"), T.round4(F.col(f"mu{k}")).alias("mu"), T.round4(F.col(f"sd{k}")).alias("sd")) for k, f in enumerate(_DISTINCT)]
    return _profile(_block_frequencies(spark, sf_dir)).select("lang", F.inline(F.array(*rows)))


@query("sty_03_delta", f"WITH {_PROF} SELECT doc_id, block_index, {_R3.format('sum(times * abs((f - mu) / sd)) / sum(times)')} AS delta FROM bf JOIN pr ON pr.lang = 'en' AND pr.feature = bf.feature WHERE sd > 1e-9 GROUP BY 1, 2")
def sty_03(spark, sf_dir):
    """The block frequencies, nine numbers a block, are stored: the profile and the distances both read them."""
    blocks = G.shared_table(_block_frequencies(spark, sf_dir), "frequencies")
    en = _profile(blocks.where("lang = 'en'")).first()  # one row: mean and deviation of each feature
    z, times = F.lit(0.0), 0
    for k, f in enumerate(_DISTINCT):
        if en and en[f"sd{k}"] is not None and en[f"sd{k}"] > 1e-9:
            z = z + F.abs((F.col(f"f{k}") - en[f"mu{k}"]) / en[f"sd{k}"]) * _FEATURES.count(f)
            times += _FEATURES.count(f)
    out = blocks.select("doc_id", (F.col("pos") + 1).cast("long").alias("block_index"), T.round3(z / max(1, times)).alias("delta"))
    return out if times else out.limit(0)


_MARKERS = ["the", "tion", "er", "eau", "sch"]
_HITS = " + ".join(f"(length(text) - length(replace(text, '{m}', ''))) / {len(m)}" for m in _MARKERS)


@query("sty_04_style_intensity", rf"WITH d AS (SELECT doc_id, lang, ({_HITS}) * 100.0::DOUBLE / greatest(1, length(regexp_replace(text, '[\s\p{{Z}}]', '', 'g'))) AS v FROM documents), b AS (SELECT lang, avg(v) AS base FROM d GROUP BY 1) SELECT doc_id, {_R3.format('v')} AS intensity, {_R3.format('v / base')} AS ratio FROM d JOIN b ON b.lang = d.lang")
def sty_04(spark, sf_dir):
    hits = sum((T.count_of(F.col("text"), m) for m in _MARKERS), F.lit(0.0))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (hits * 100.0 / F.greatest(F.lit(1), T.non_blank_length("text"))).alias("v"))
    base = d.groupBy("lang").agg(F.avg("v").alias("base"))
    return d.join(base, "lang").select("doc_id", T.round3(F.col("v")).alias("intensity"), T.round3(F.try_divide("v", "base")).alias("ratio"))


@query("sty_05_stylometry", rf"""WITH s AS (SELECT doc_id, text, length(regexp_replace(text, '[\s\p{{Z}}]', '', 'g')) AS n, list_transform(list_filter(regexp_split_to_array(text, '[.。！？!?]+'), lambda x: regexp_replace(x, '[\s\p{{Z}}]', '', 'g') <> ''), lambda x: length(regexp_replace(x, '[\s\p{{Z}}]', '', 'g'))) AS ls FROM documents)
SELECT doc_id, CAST(n AS BIGINT) AS char_count, CAST(len(ls) AS BIGINT) AS sentence_count, {_R3.format('list_sum(ls) / greatest(1, len(ls))')} AS avg_sentence_len, {_R4.format('len(list_filter(ls, lambda x: x <= 8)) / greatest(1, len(ls))')} AS short_ratio,
CAST(len(regexp_extract_all(text, '[！!]')) AS BIGINT) AS exclamations, {_R4.format("len(regexp_extract_all(lower(text), '[a-z]')) / greatest(1, n)")} AS latin_ratio FROM s""")
def sty_05(spark, sf_dir):
    sizes = F.filter(F.transform(F.split("text", r"[.。！？!?]+"), T.non_blank_length), lambda n: n > 0)
    s = table(spark, sf_dir, "documents").select("doc_id", "text", T.non_blank_length("text").alias("n"), sizes.alias("ls"))
    total = F.aggregate("ls", F.lit(0), lambda a, x: a + x)
    n_s, one = F.size("ls"), F.lit(1)
    return s.select(
        "doc_id", F.col("n").cast("long").alias("char_count"), n_s.cast("long").alias("sentence_count"), T.round3(total / F.greatest(one, n_s)).alias("avg_sentence_len"),
        T.round4(F.size(F.filter("ls", lambda x: x <= 8)) / F.greatest(one, n_s)).alias("short_ratio"), F.regexp_count("text", F.lit("[！!]")).cast("long").alias("exclamations"),
        T.round4(F.regexp_count(F.lower("text"), F.lit("[a-z]")) / F.greatest(one, "n")).alias("latin_ratio"),
    )


@query("sty_06_condition_summary", f"SELECT lang, CASE WHEN doc_id % 2 = 0 THEN 'full' ELSE 'neutral' END AS condition, count(*) AS n, {_R3.format('avg(length(text))')} AS mean_chars, CAST(max(length(text)) AS BIGINT) AS most FROM documents GROUP BY 1, 2")
def sty_06(spark, sf_dir):
    condition = F.when(F.col("doc_id") % 2 == 0, "full").otherwise("neutral")
    return table(spark, sf_dir, "documents").groupBy("lang", condition.alias("condition")).agg(F.count("*").alias("n"), T.round3(F.avg(F.length("text"))).alias("mean_chars"), F.max(F.length("text")).cast("long").alias("most"))


