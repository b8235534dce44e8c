"""Schema validation, paired statistics, judge agreement and deterministic patches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T


def violations(rules: dict[str, dict]) -> Column:
    """Array of error texts by the JSON-schema subset: required, enum, minimum, maximum for columns. An integer out of
    bounds is reported twice, once as an integer and once as a number."""
    errors = []
    for name, rule in rules.items():
        c = F.col(name)
        if rule.get("required"):
            errors.append(F.when(c.isNull(), f"$.{name}: missing required field"))
        if "enum" in rule:
            errors.append(F.when(c.isNotNull() & ~c.isin(*rule["enum"]), f"$.{name}: expected one of {rule['enum']!r}"))
        for _ in range(2 if rule.get("type") == "integer" else 1):
            if "minimum" in rule:
                errors.append(F.when(c < rule["minimum"], f"$.{name}: expected >= {rule['minimum']}"))
            if "maximum" in rule:
                errors.append(F.when(c > rule["maximum"], f"$.{name}: expected <= {rule['maximum']}"))
    return F.array_compact(F.array(*errors))


def paired_tests(pairs: DataFrame, keys: list[str], rounds: int = 2000, seed: int = 7, ci: float = 95.0) -> DataFrame:
    """pairs (keys, item, a, b), one row an item -> (keys, n, diff, ci_low, ci_high, p_value): bootstrap over items and sign flips.

    Resampling weighs are drawn for each item by itself from a generator seeded by the item, and summed by round, so a
    contrast of any number of items is spread over tasks: Poisson(1) weights for the bootstrap, random signs for the test."""
    spec = f"{', '.join(f'`{k}` {pairs.schema[k].dataType.simpleString()}' for k in keys)}, r int, wd double, w double, sd double, d double, n long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                rng = np.random.default_rng([seed, zlib.crc32(str(row.item).encode())])
                w, s, d = rng.poisson(1.0, rounds), rng.choice((-1.0, 1.0), rounds), row.a - row.b
                acc = sums.setdefault(key, [np.zeros(rounds), np.zeros(rounds), np.zeros(rounds), 0.0, 0])
                acc[0] += w * d
                acc[1] += w
                acc[2] += s * d
                acc[3] += d
                acc[4] += 1
        for key, (wd, w, sd, d, n) in sums.items():
            yield pd.DataFrame({**{k: [v] * rounds for k, v in zip(keys, key)}, "r": range(rounds), "wd": wd, "w": w, "sd": sd, "d": d, "n": n})

    sums = pairs.mapInPandas(run, spec).groupBy(*keys, "r").agg(*[F.sum(c).alias(c) for c in ("wd", "w", "sd", "d", "n")])
    stat = sums.withColumn("boot", F.try_divide("wd", "w")).withColumn("extreme", (F.abs(F.col("sd") / F.col("n")) >= F.abs(F.col("d") / F.col("n")) - 1e-12).cast("int"))
    tail = (100 - ci) / 200
    return stat.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max(F.col("d") / F.col("n")).alias("diff"),
        F.percentile("boot", F.lit(tail)).alias("ci_low"),
        F.percentile("boot", F.lit(1 - tail)).alias("ci_high"),
        ((F.sum("extreme") + 1) / (F.count("*") + 1)).alias("p_value"),
    )


def agreement(scores: DataFrame) -> DataFrame:
    """scores (item, condition, judge, score) -> for each pair of judges: n, exact, within_one, pearson (null if either is constant)."""
    b = scores.select("item", "condition", F.col("judge").alias("other"), F.col("score").alias("score2"))
    both = scores.join(b, ["item", "condition"]).where("judge < other")
    x, y = F.col("score").cast("double"), F.col("score2").cast("double")
    g = both.groupBy("judge", "other").agg(
        F.count("*").alias("n"), F.avg((x == y).cast("int")).alias("e"), F.avg((F.abs(x - y) <= 1).cast("int")).alias("w"),
        F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
    )
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    r = F.when((vx > 1e-12) & (vy > 1e-12), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy))
    return g.select("judge", "other", "n", T.round4(F.col("e")).alias("exact"), T.round4(F.col("w")).alias("within_one"), T.round4(r).alias("pearson"))


def patched(rows: DataFrame, key: str, dropped: DataFrame, edits: DataFrame, column: str) -> DataFrame:
    """Rows without the dropped keys, with edited values where there are any."""
    kept = rows.join(dropped.select(key), key, "left_anti")
    return kept.join(edits.select(key, F.col(column).alias("edit")), key, "left").withColumn(column, F.coalesce("edit", column)).drop("edit")


# Fixed value: what ends a sentence of a passage that is cut out.
SENTENCE_ENDS = "。！？”』」"


def normalized(c: Column | str) -> Column:
    """Letters and digits of any script alone, so that marks and quotes make no difference."""
    return F.regexp_replace(T.col(c), r"[^\p{L}\p{N}]", "")


def verify_evidence(docs: DataFrame, items: DataFrame, most: int = 2000, least: int = 0) -> DataFrame:
    """docs (doc_id, bare), items (item_id, needle) -> (item_id, n_docs) of needles of at least ``least`` characters that occur. Up to ``most`` needles, counted, are looked for
    in each document as it is read; more of them meet the documents' grams of eight characters (of a shorter needle: of its length) in an equi-join
    first, whose rows hold no text; texts are joined back for the pairs that met. On both ways an empty needle occurs in every document that has a text, null in none."""
    items = items.where(F.length("needle") >= least) if least else items
    few = items.limit(most + 1).collect()
    if len(few) <= most:
        listed = F.array(*[F.struct(F.lit(r["item_id"]).cast("long").alias("item_id"), F.lit(r["needle"]).alias("needle")) for r in few])
        found = docs.select("doc_id", F.explode(F.filter(listed, lambda x: F.contains(F.col("bare"), x["needle"]))).alias("x"))
        return found.groupBy("x.item_id").agg(F.count_distinct("doc_id").alias("n_docs"))
    size = F.least(F.length("needle"), F.lit(8))
    sizes = [r[0] for r in items.where("needle is not null").select(size).distinct().collect()]  # nine numbers at most

    def grams(n: int):
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("bare") - (n - 1))) if n else F.array(F.lit(1))
        return F.transform(starts, lambda i: F.substring(F.col("bare"), i, F.lit(n)))

    found = F.array_distinct(F.concat(F.array().cast("array<string>"), *[grams(n) for n in sizes]))
    keyed = docs.select("doc_id", F.explode(found).alias("key"))
    met = keyed.join(items.withColumn("key", F.substring("needle", 1, 8)), "key").select("doc_id", "item_id", "needle")
    return met.join(docs, "doc_id").where(F.contains("bare", "needle")).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"))


def anti_spoiler_met(expected: Column, safe: Column, reason: Column, answer: Column) -> Column:
    """Whether a response is what the sample expects: a refusal for that reason, or an answer that says something; anything else is not met."""
    says = T.strip(F.coalesce(answer, F.lit(""))) != ""
    return (
        F.when(expected == "refuse_future_plot", ~safe & (reason == "question_requests_future_plot"))
        .when(expected.isin("answer_within_boundary", "acknowledge_uncertainty", "reflect_on_known_text_only"), safe & says)
        .otherwise(False)
    )


def dissociation(means: DataFrame, key: str) -> DataFrame:
    """means (key, axis: thinking or style, neutral, style_only, thinking_only, full) -> the verdict of each key: does each axis rise with its own factor, and is it flat on the
    other one (a swing of under half that on its own)? ``flat`` is null where a mean is missing."""

    def rises(axis: str, own: str) -> Column:
        at = lambda c: F.col(f"{axis}_{c}")
        return F.coalesce((at("full") > at("neutral")) & (at(own) > at("neutral")), F.lit(False))

    def flat(axis: str, own: str, other: str) -> Column:
        at = lambda c: F.col(f"{axis}_{c}")
        return F.abs(at(other) - at("neutral")) < F.abs(at(own) - at("neutral")) / 2 + 1e-9

    conditions = ("neutral", "style_only", "thinking_only", "full")
    wide = means.groupBy(key).agg(*[F.max(F.when(F.col("axis") == a, F.col(c))).alias(f"{a}_{c}") for a in ("thinking", "style") for c in conditions])
    out = wide.select(
        key,
        rises("style", "style_only").alias("style_tracks_style"),
        flat("style", "style_only", "thinking_only").alias("style_flat_on_thinking"),
        rises("thinking", "thinking_only").alias("thinking_tracks_thinking"),
        flat("thinking", "full", "style_only").alias("thinking_flat_on_style"),
    )
    holds = F.col("style_tracks_style") & F.col("thinking_tracks_thinking") & F.col("style_flat_on_thinking") & F.col("thinking_flat_on_style")
    return out.withColumn("double_dissociation", F.coalesce(holds, F.lit(False)))


def anchor_at(anchor: Column, text: Column) -> Column:
    """Where (from 0) an anchor stands in a text, as it is or else by its letters and digits (five at least); -1 where it doesn't."""
    exact = F.instr(text, anchor) - 1
    bare = normalized(anchor)
    among = F.instr(normalized(text), bare) - 1
    # the shortest beginning of the text with one more letter than stand before the anchor ends with its first one
    pattern = F.concat(F.lit(r"^(?:[^\p{L}\p{N}]*[\p{L}\p{N}]){"), F.greatest(among + 1, F.lit(1)).cast("string"), F.lit("}"))
    reach = F.length(F.call_function("regexp_extract", text, pattern, F.lit(0))) - 1
    return F.when((anchor != "") & (exact >= 0), exact).when((F.length(bare) >= 5) & (among >= 0), reach).otherwise(-1)


def setup_start(text: Column, at: Column, back: int = 260) -> Column:
    """Where the sentences before a place begin: about ``back`` characters before it, after the first sentence end or line end from there on."""
    low = F.greatest(F.lit(0), at - back)
    first = F.regexp_instr(F.substring(text, low + 1, at - low), F.lit(f"[{SENTENCE_ENDS}\n]"))
    return F.when(low == 0, 0).when(first > 0, low + first).otherwise(low)


def passage_end(text: Column, at: Column, want: int = 220, more: int = 80) -> Column:
    """Where a passage from a place ends: at the first sentence end ``want`` characters on, ``more`` beyond that at most."""
    high = F.least(F.length(text), at + want)
    nxt = F.regexp_instr(F.substring(text, high + 1, F.length(text)), F.lit(f"[{SENTENCE_ENDS}]"))
    return F.least(F.when(nxt > 0, high + nxt).otherwise(F.length(text)), at + want + more)


def highlight_met(errors: Column, safe: Column, answer: Column, expected: Column, got: Column) -> Column:
    """Whether a sample without schema errors got a safe answer that says something, from passages that include all that were expected."""
    return (F.size(errors) == 0) & safe & (T.strip(F.coalesce(answer, F.lit(""))) != "") & (F.size(F.array_except(expected, got)) == 0)


def phrases(text: Column, expected: Column, forbidden: Column) -> tuple[Column, Column, Column]:
    """(missing, leaked, passed): expected phrases that a text lacks and forbidden ones that it has, letter for letter; null lists are empty."""
    none = F.array().cast("array<string>")
    missing = F.filter(F.coalesce(expected, none), lambda p: ~F.contains(text, p))
    leaked = F.filter(F.coalesce(forbidden, none), lambda p: F.contains(text, p))
    return missing, leaked, (F.size(missing) == 0) & (F.size(leaked) == 0)


def mcq_items(votes: DataFrame, keys: list[str]) -> DataFrame:
    """votes (keys, condition, run, choice or null, correct) -> (keys, condition, n_valid, acc, majority, majority_correct): of equally frequent choices the one chosen first."""
    n = votes.groupBy(*keys, "condition", "correct").agg(F.count("choice").alias("n_valid"), F.count_if(F.col("choice") == F.col("correct")).alias("n_correct"))
    each = votes.where("choice is not null").groupBy(*keys, "condition", "choice").agg(F.count("*").alias("n"), F.min("run").alias("first"))
    best = each.groupBy(*keys, "condition").agg(F.max_by("choice", F.struct("n", -F.col("first"))).alias("majority"))
    rows = n.join(best, [*keys, "condition"], "left")
    return rows.select(*keys, "condition", "n_valid", T.round3(F.try_divide("n_correct", "n_valid")).alias("acc"), "majority", F.coalesce(F.col("majority") == F.col("correct"), F.lit(False)).alias("majority_correct"))


def mcq_summary(items: DataFrame, keys: list[str], baseline: str = "neutral") -> DataFrame:
    """items as mcq_items() makes them -> (condition, n_items, n_distinctive, acc_all_soft, acc_all_majority, acc_distinctive_majority); an item is distinctive if the baseline's majority is wrong on it."""
    wrong = items.where((F.col("condition") == baseline) & ~F.col("majority_correct")).select(*keys, F.lit(1).alias("distinctive"))
    rows = items.join(wrong, keys, "left")
    right, special = F.col("majority_correct").cast("int"), F.col("distinctive").isNotNull()
    return rows.groupBy("condition").agg(
        F.count("*").alias("n_items"), F.count_if(special).alias("n_distinctive"), T.round3(F.avg("acc")).alias("acc_all_soft"), T.round3(F.avg(right)).alias("acc_all_majority"),
        T.round3(F.avg(F.when(special, right))).alias("acc_distinctive_majority"),
    )


def continuation_means(scores: DataFrame) -> DataFrame:
    """scores (condition, judge, item, score or null) -> (condition, judge, n_items, n_scored, mean_score): items that a judge left out don't count in its mean."""
    return scores.groupBy("condition", "judge").agg(F.count("*").alias("n_items"), F.count("score").alias("n_scored"), T.round3(F.avg("score")).alias("mean_score"))
