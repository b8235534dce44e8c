"""Prompts for extraction, as columns: one a window or one a chunk. What a prompt says comes from tables; its wording is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

#: The wording, in parts; ``{}`` is where values go.
SYSTEM = (
    "You extract entities and facts from passages of a book. Answer with JSON alone: {\"chunks\": [{\"chunk_id\", \"entities\": [{\"canonical_name\", \"entity_type\", \"aliases\", \"evidence\", \"confidence\"}], "
    "\"facts\": [{\"source\", \"target\", \"relation_type\", \"state_family\", \"directionality\", \"fact\", \"evidence\", \"confidence\"}]}]}. "
    "The same name may be another person in another generation: compare age, descent, looks and deeds with the entities known so far, and make a new entity where they disagree. "
    "Evidence is quoted word for word. Entity types: {types}. Relation types: {relations}."
)
NONE = "- none"


def system_prompt(entity_types: list[str], relation_types: list[str], wording: str = SYSTEM) -> str:
    return wording.replace("{types}", ", ".join(entity_types)).replace("{relations}", ", ".join(relation_types))


def _lines(values: Column, most: int) -> Column:
    """Values that aren't blank as a list, or the line for none."""
    shown = F.slice(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: T.strip(v) != ""), 1, most)
    return F.when(F.size(shown) == 0, F.lit(NONE)).otherwise(F.array_join(F.transform(shown, lambda v: F.concat(F.lit("- "), v)), "\n"))


def known_entity_lines(known: DataFrame, keys: list[str]) -> DataFrame:
    """known (keys, rank, name, type, aliases, summary) -> (keys, known: array of lines by rank)."""
    also = F.array_join(F.filter("aliases", lambda a: a != F.col("name")), ", ")
    line = F.concat("name", F.lit(" ("), "type", F.lit(")"), F.when(also != "", F.concat(F.lit(", also "), also)).otherwise(""), F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(": "), T.clip("summary", 120, "…"))).otherwise(""))
    g = known.withColumn("line", line).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("xs"))
    return g.select(*keys, F.transform("xs", lambda x: x["line"]).alias("known"))


def window_prompts(windows: DataFrame, keys: list[str], most_known: int = 25, most_before: int = 3) -> DataFrame:
    """windows (keys, title, chunks: array of (chunk_id, text) in order, before: array of texts, known: array of lines, family: array of lines, cast: array of lines) -> (keys, prompt).

    The last ``most_before`` texts before the window come first, then who is known (descent, looks, all), then the chunks with their ids."""
    before = F.slice(F.reverse("before"), 1, most_before)
    chunks = F.array_join(F.transform("chunks", lambda c: F.concat(F.lit("["), c["chunk_id"], F.lit("]\n"), T.strip(c["text"]))), "\n\n")
    parts = [("Book", F.col("title")), ("Before this", _lines(F.reverse(before), most_before)), ("Descent", _lines(F.col("family"), 60)), ("Who they are", _lines(F.col("cast"), 60)), ("Known entities", _lines(F.col("known"), most_known)), ("Passages", chunks)]
    return windows.select(*keys, F.concat_ws("\n\n", *[F.concat(F.lit(f"{name}:\n"), value) for name, value in parts]).alias("prompt"))


def chunk_prompts(chunks: DataFrame, keys: list[str], most_known: int = 25) -> DataFrame:
    """chunks (keys, title, chunk_id, text, before, known, family, cast) -> (keys, prompt): a window of one chunk."""
    one = chunks.withColumn("chunks", F.array(F.struct("chunk_id", "text")))
    return window_prompts(one, keys, most_known)
