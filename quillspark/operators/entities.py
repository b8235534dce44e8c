"""Entity resolution: names, aliases, matches, merges and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

# Honorifics and titles that names are compared without.
HONORIFICS = ("堂", "唐")
TITLES = ("上校", "将军", "第二", "第一", "先生", "夫人", "小姐", "女士", "上尉", "中尉")
TYPES = ("character", "location", "concept", "group", "theme", "artifact", "unknown")
TYPE_LABELS = {"character": "角色", "location": "地点", "artifact": "物品", "group": "团体/组织", "concept": "概念/主题", "unknown": "未知"}


def aliases(name: Column | str) -> Column:
    """The name and, of several words, the last; sorted."""
    n = T.collapse(name)
    last = F.element_at(F.split(n, " "), -1)
    return F.array_sort(F.array_distinct(F.array(n, last)))


def variants(name: Column | str) -> Column:
    """Slugs of the name as it is, without one honorific, then without each title in turn, and without middle dots."""
    n = T.col(name)
    bare = n
    for p in reversed(HONORIFICS):
        bare = F.when(F.startswith(n, F.lit(p)) & (F.length(n) > len(p) + 1), F.substring(n, F.lit(len(p) + 1), F.length(n))).otherwise(bare)

    def drop(acc: Column, title: Column) -> Column:
        now = acc["now"]
        short = F.regexp_replace(F.substring(now, F.lit(1), F.length(now) - F.length(title)), "[· ]+$", "")
        left = F.when(F.endswith(now, title) & (F.length(now) > F.length(title) + 1), short).otherwise(now)
        return F.struct(left.alias("now"), F.array_append(acc["found"], left).alias("found"))

    start = F.struct(bare.alias("now"), F.array(n, bare, F.replace(n, F.lit("·"), F.lit(" "))).alias("found"))
    found = F.aggregate(F.array(*map(F.lit, TITLES)), start, drop, lambda acc: acc["found"])
    return F.array_sort(F.array_distinct(F.transform(found, lambda v: T.slugify(v))))


def resolve(candidates: DataFrame, registry: DataFrame, fewest: int = 3) -> DataFrame:
    """candidates (cand_id, name, hint) against registry (entity_id, slug, kind: alias or fuzzy, mention_count) -> (cand_id, entity_id, how).

    The hint's slug comes first, then any alias, then the fuzzy key of the most mentioned entity with ``fewest`` mentions or more;
    else the name makes an entity of its own. All three are equi-joins on slugs."""
    alias = registry.where("kind = 'alias'").groupBy("slug").agg(F.min("entity_id").alias("entity_id"))
    best = F.max(F.struct("mention_count", "entity_id"))["entity_id"]
    fuzzy = registry.where(F.col("mention_count") >= fewest).groupBy("slug").agg(best.alias("entity_id"))
    c = candidates.withColumn("hint_slug", T.slugify("hint")).withColumn("name_slug", T.slugify("name"))
    by_hint = c.join(alias, c["hint_slug"] == alias["slug"]).select("cand_id", F.col("entity_id").alias("by_hint"))
    by_alias = c.select("cand_id", F.explode(F.transform(aliases("name"), lambda a: T.slugify(a))).alias("s")).join(alias, F.col("s") == alias["slug"]).groupBy("cand_id").agg(F.min("entity_id").alias("by_alias"))
    by_fuzzy = c.select("cand_id", F.explode(variants("name")).alias("s")).join(fuzzy, F.col("s") == fuzzy["slug"]).groupBy("cand_id").agg(F.min("entity_id").alias("by_fuzzy"))
    out = c.join(by_hint, "cand_id", "left").join(by_alias, "cand_id", "left").join(by_fuzzy, "cand_id", "left")
    how = F.when(F.col("by_hint").isNotNull(), "hint").when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_fuzzy").isNotNull(), "fuzzy").otherwise("new")
    return out.select("cand_id", F.coalesce("by_hint", "by_alias", "by_fuzzy", F.concat(F.lit("entity_"), F.col("name_slug"))).alias("entity_id"), how.alias("how"))


def from_mentions(mentions: DataFrame, keys: list[str], slug: str = "slug") -> DataFrame:
    """Entities: one mention an episode counts; first and last place as (chapter, paragraph)."""
    place = F.struct("chapter_index", "paragraph_index")
    once = mentions.groupBy(*keys, slug, "chapter_index", "paragraph_index").agg(F.min("name").alias("name"))
    return once.groupBy(*keys, slug).agg(
        F.min("name").alias("name"),
        F.count("*").alias("mention_count"),
        F.min(place).alias("first_seen"),
        F.max(place).alias("last_seen"),
        F.array_sort(F.collect_set("chapter_index")).alias("chapters"),
    )


def match_in_episode(names: DataFrame, entities: DataFrame, on: list[str]) -> DataFrame:
    """names (on, wanted) x the few entities of the same episode (on, entity, ord): equal first, then one containing the other."""
    a, b = F.lower("wanted"), F.lower("entity")
    rank = F.when(a == b, 0).when(F.contains(a, b) | F.contains(b, a), 1)
    hits = names.join(entities, on).withColumn("rank", rank).where("rank is not null")
    return hits.groupBy(*on, "wanted").agg(F.min_by("entity", F.struct("rank", "ord")).alias("entity"), F.min("rank").cast("long").alias("rank"))


def chapter_survivors(entities: DataFrame, keys: list[str]) -> DataFrame:
    """Of entities with the same slug in a chapter, the most mentioned one absorbs the others: adds survivor."""
    w = Window.partitionBy(*keys)
    return entities.withColumn("survivor", F.max(F.struct("mention_count", "entity_id")).over(w)["entity_id"])


def alias_merges(entities: DataFrame, family: DataFrame) -> DataFrame:
    """entities (entity_id, name, type, aliases, mention_count), family (a, b) -> (absorbed, survivor).

    An entity whose name is an alias of another one of its type, unless they are family, merges with the most mentioned such one; the
    less mentioned of the two goes. The alias is an equi-join key, so nothing is compared with everything."""
    other = entities.select(F.col("entity_id").alias("o_id"), F.col("type").alias("o_type"), F.col("mention_count").alias("o_count"), F.explode("aliases").alias("alias"))
    pairs = entities.join(other, (entities["name"] == other["alias"]) & (entities["type"] == other["o_type"]) & (entities["entity_id"] != other["o_id"]))
    both = family.select("a", "b").union(family.select("b", "a")).distinct()
    pairs = pairs.join(both, (pairs["entity_id"] == both["a"]) & (pairs["o_id"] == both["b"]), "left_anti")
    best = pairs.groupBy("entity_id", "mention_count").agg(F.max(F.struct("o_count", "o_id")).alias("x"))
    keeps = F.col("x.o_count") >= F.col("mention_count")
    return best.select(F.when(keeps, F.col("entity_id")).otherwise(F.col("x.o_id")).alias("absorbed"), F.when(keeps, F.col("x.o_id")).otherwise(F.col("entity_id")).alias("survivor")).distinct()


def summaries(entities: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """entities (keys, slug, name, type, chapters, mention_count), facts (keys, slug, fact): three longest facts, else the type's label."""
    longest = F.array_sort(F.collect_set(F.struct((-F.length("fact")).alias("n"), "fact")))
    known = facts.groupBy(*keys, "slug").agg(F.array_join(F.transform(F.slice(longest, 1, 3), lambda x: x["fact"]), "；").alias("facts"))
    first, last = F.array_min("chapters"), F.array_max("chapters")
    span = F.when(first == last, F.concat(F.lit("ch"), first)).otherwise(F.concat(F.lit("ch"), first, F.lit("-"), last))
    label = F.coalesce(_label(F.col("type")), F.col("type"))
    body = F.when(F.col("facts").isNotNull(), F.concat("name", F.lit(" — "), "facts")).otherwise(F.concat("name", F.lit("（"), label, F.lit("）")))
    tail = F.when((F.col("mention_count") == 1) & (F.col("type") == "character"), " 仅出现一次，可能为零散提及。").otherwise("")
    text = F.concat(body, F.lit("。出现在 "), span, F.lit("，共 "), F.col("mention_count"), F.lit(" 次提及。"), tail)
    return entities.join(known, [*keys, "slug"], "left").withColumn("summary", text)


def _label(kind: Column) -> Column:
    out = None
    for name, label in TYPE_LABELS.items():
        out = F.when(kind == name, label) if out is None else out.when(kind == name, label)
    return out
