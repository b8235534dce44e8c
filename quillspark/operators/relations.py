"""Relation normalisation and the bitemporal fold of facts into edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Relation type, family, state family, directionality, state slot, aliases.
SCHEMA = [
    ("FAMILY_OF", "identity", "identity", "undirected", None, ["KIN_OF", "MARRIED_TO", "PARENT_OF", "CHILD_OF"]),
    ("LOCATED_IN", "state", "location", "directed", "location", ["LIVES_IN", "STAYS_IN", "RESIDES_IN"]),
    ("MEMBER_OF", "state", "membership", "directed", "membership", ["BELONGS_TO"]),
    ("OWNS", "state", "status", "directed", "ownership", ["HAS", "USES"]),
    ("SPOKE_WITH", "eventive", "interaction", "undirected", None, ["TALKED_TO", "CONVERSED_WITH"]),
    ("CONFLICTS_WITH", "eventive", "interaction", "undirected", None, ["FOUGHT_WITH", "OPPOSES"]),
    ("CARES_ABOUT", "interpretive", "sentiment", "directed", None, ["LOVES", "WORRIES_ABOUT"]),
    ("ACCOMPANIES", "eventive", "context", "undirected", None, ["TRAVELS_WITH", "GOES_WITH"]),
    ("DISCOVERED", "eventive", "context", "directed", None, ["FOUND", "UNEARTHED", "ENCOUNTERED"]),
    ("DIED_AT", "eventive", "context", "directed", None, ["DIED_IN"]),
    ("BODY_DISPOSED_AT", "eventive", "context", "directed", None, ["BURIED_AT", "CAST_INTO"]),
    ("LEADS_COMMUNITY", "interpretive", "membership", "directed", None, ["GUIDES", "ORGANIZES"]),
]
DISCOVERY = ("发现", "发掘", "挖出", "挖掘出", "找到", "见到", "看见", "赫然停着", "unearth", "found")
DEATH = ("死于", "死在", "病死", "热病", "died", "death")
DISPOSAL = ("尸体被丢", "被丢到", "被丢到了", "埋在", "葬在", "body was thrown", "cast into")
LEADERSHIP = ("族长式人物", "指导村社事务", "指导人们", "规划了街道", "leader", "guided")
CATEGORIES = [
    ("family", ["family", "parent", "child", "sibling", "spouse", "mother", "father", "亲", "父", "母", "子", "女", "兄", "弟", "姐", "妹", "夫", "妻"]),
    ("conflict", ["conflict", "enemy", "oppose", "fight", "threat", "kill", "hate", "rival", "betray", "冲突", "敌", "杀", "恨", "威胁", "对抗", "背叛"]),
    ("affinity", ["love", "friend", "ally", "trust", "help", "protect", "care", "mentor", "情", "友", "爱", "信任", "帮助", "保护", "师"]),
    ("interaction", ["speak", "talk", "meet", "interact", "see", "ask", "answer", "spoke", "交谈", "相遇", "看见", "问", "答"]),
    ("location", ["located", "location", "place", "live", "arrive", "leave", "位于", "地点", "居住", "来到", "离开"]),
    ("theme", ["theme", "symbol", "concept", "metaphor", "主题", "象征", "隐喻"]),
]

FALLBACK = ("context", "context", "undirected")


def schema_table(spark: SparkSession) -> DataFrame:
    """One row for each name a relation type goes by: 12 types and their aliases, so always small enough to broadcast."""
    rows = [(alias, *entry[:5]) for entry in SCHEMA for alias in [entry[0], *entry[5]]]
    return spark.createDataFrame(rows, "alias string, relation_type string, relation_family string, state_family string, directionality string, state_slot string")


def relation_entries(facts: DataFrame, raw_type: str) -> DataFrame:
    """facts and their registry entry by type or alias; unknown types are undirected context."""
    key = F.upper(F.trim(raw_type))
    known = F.broadcast(schema_table(facts.sparkSession))
    family, state, direction = FALLBACK
    joined = facts.join(known, key == known["alias"], "left")
    return joined.select(
        *[facts[c] for c in facts.columns],
        F.coalesce("relation_type", key).alias("relation_type"),
        F.coalesce("relation_family", F.lit(family)).alias("relation_family"),
        F.coalesce("state_family", F.lit(state)).alias("state_family"),
        F.coalesce("directionality", F.lit(direction)).alias("directionality"),
        "state_slot",
    )


def _has(text: Column, markers: tuple[str, ...]) -> Column:
    return F.rlike(F.lower(text), F.lit("|".join(markers)))


def remap(relation_type: Column, fact: Column, target_type: Column) -> tuple[Column, Column]:
    """(type, note) by the ordered rules. Each needs the type that no earlier one has changed, so the first that fits is final."""
    located = relation_type == "LOCATED_IN"
    rules = [
        (relation_type.isin("LOCATED_IN", "OWNS") & _has(fact, DISCOVERY), "DISCOVERED", "mapped_discovery_event_from_state_relation"),
        (located & _has(fact, DEATH), "DIED_AT", "mapped_death_event_from_location_relation"),
        (located & _has(fact, DISPOSAL), "BODY_DISPOSED_AT", "mapped_body_disposal_event_from_location_relation"),
        ((relation_type == "MEMBER_OF") & _has(fact, LEADERSHIP), "LEADS_COMMUNITY", "mapped_leadership_relation_from_membership"),
        (located & (target_type == "artifact"), "DISCOVERED", "artifact_target_not_valid_for_stable_location"),
    ]
    kind, note = F.when(*(rules[0][0], F.lit(rules[0][1]))), F.when(*(rules[0][0], F.lit(rules[0][2])))
    for condition, to, why in rules[1:]:
        kind, note = kind.when(condition, to), note.when(condition, why)
    return kind.otherwise(relation_type), note.otherwise(F.lit(""))


def normalize_facts(facts: DataFrame) -> DataFrame:
    """facts (raw_type, raw_family, raw_directionality, fact, target_type, ...) -> and relation_type, relation_family, state_family,
    directionality, state_slot, note. Raw family (unless context) and directionality win unless a rule changes the type."""
    entries = relation_entries(facts, "raw_type")
    kind, note = remap(F.col("relation_type"), F.trim("fact"), F.col("target_type"))
    entries = entries.withColumn("note", note).withColumn("new_type", kind)
    new = F.broadcast(schema_table(facts.sparkSession).where("alias = relation_type"))
    mapped = entries.alias("f").join(new.alias("n"), F.col("f.new_type") == F.col("n.alias"), "left")
    changed = F.col("f.note") != ""
    raw_family = F.when(F.col("f.raw_family") == "context", F.col("f.state_family")).otherwise(F.col("f.raw_family"))
    return mapped.select(
        *[F.col(f"f.{c}") for c in facts.columns],
        F.col("f.new_type").alias("relation_type"),
        F.when(changed, F.col("n.relation_family")).otherwise(F.col("f.relation_family")).alias("relation_family"),
        F.when(changed, F.col("n.state_family")).otherwise(raw_family).alias("state_family"),
        F.when(changed, F.col("n.directionality")).otherwise(F.coalesce(F.nullif("f.raw_directionality", F.lit("")), F.col("f.directionality"))).alias("directionality"),
        F.when(changed, F.col("n.state_slot")).otherwise(F.col("f.state_slot")).alias("state_slot"),
        F.col("f.note").alias("note"),
    )


def state_key(slot: Column, source: Column, target: Column, directionality: Column) -> Column:
    pair = F.concat_ws("|", slot, F.least(source, target), F.greatest(source, target))
    return F.when(slot.isNull(), "").when(directionality == "undirected", pair).otherwise(F.concat_ws("|", slot, source))


def signature(kind: Column, family: Column, source: Column, target: Column, directionality: Column) -> Column:
    a = F.when(directionality == "undirected", F.least(source, target)).otherwise(source)
    b = F.when(directionality == "undirected", F.greatest(source, target)).otherwise(target)
    return F.concat_ws("|", kind, family, a, b)


def category(kind: Column, fact: Column) -> Column:
    text = F.lower(F.concat(kind, F.lit(" "), fact))
    out = None
    for name, words in CATEGORIES:
        hit = F.rlike(text, F.lit("|".join(words)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def edges(facts: DataFrame, order: list[str], keys: tuple[str, str] = ("signature", "state_key")) -> DataFrame:
    """Facts with a signature and a state key -> one edge a signature: weight, first facts, greatest confidence. The
    partial sums of repeats are taken before the shuffle."""
    signature_, state = keys
    first = F.min(F.struct(*order))
    return facts.groupBy(signature_, state, "source", "target").agg(F.count("*").alias("weight"), first.alias("first"), F.max("confidence").alias("confidence"))


def supersede(found: DataFrame, state: str = "state_key") -> DataFrame:
    """Edges (with ``first``) -> and invalid_at, invalidated_by, status: the next edge with the same state key ends an edge. An empty
    key never does. A repeat of an ended signature adds weight to it and doesn't revive it (reference mode)."""
    later = Window.partitionBy(state).orderBy("first")
    stateful = found.where(F.col(state) != "")
    ended = stateful.withColumn("invalid_at", F.lead(F.col("first.valid_at")).over(later)).withColumn("invalidated_by", F.lead("signature").over(later))
    free = found.where(F.col(state) == "")
    out = ended.unionByName(free, allowMissingColumns=True)
    return out.withColumn("status", F.when(F.col("invalidated_by").isNull(), "active").otherwise("invalidated"))


def versions(facts: DataFrame, order: list[str], state: str = "state_key") -> DataFrame:
    """SCD-2 mode: each run of facts of one state with the same target is a version of its own, ended by the next run."""
    w = Window.partitionBy(state).orderBy(*order)
    runs = facts.withColumn("opens", F.coalesce((F.lag("target").over(w) != F.col("target")).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("opens").over(w))
    out = runs.groupBy(state, "run").agg(F.first("source").alias("source"), F.min_by("target", F.struct(*order)).alias("target"), F.count("*").alias("weight"), F.min(F.struct(*order)).alias("first"))
    return out.withColumn("invalid_at", F.lead("first.valid_at").over(Window.partitionBy(state).orderBy("run")))
