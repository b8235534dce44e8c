"""Graph assembly and traversal over node and edge tables."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir and read again, so that loops have short plans and survive lost executors."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "/tmp/checkpoints"
    path = f"{root.rstrip('/')}/quillspark-graph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(df: DataFrame) -> None:
    """Deletes what shared_table() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/quillspark-graph/" in path.toString():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dependencies(episodes: DataFrame, keys: list[str], back: int = 4, shared: int = 2) -> DataFrame:
    """episodes (keys, paragraph_index, names array) -> (keys, paragraph_index, depends_on): the one before in its chapter, and of the
    last ``back`` those with at least ``shared`` names in common. Earlier ones come by lag, so that no self-join is needed."""
    w = Window.partitionBy(*keys).orderBy("paragraph_index")
    cols = [F.struct(F.lag("paragraph_index", k).over(w).alias("i"), F.lag("names", k).over(w).alias("names"), F.lit(k).alias("k")) for k in range(1, back + 1)]
    near = episodes.withColumn("near", F.array(*cols)).select(*keys, "paragraph_index", "names", F.explode("near").alias("e")).where("e.i is not null")
    hit = (F.col("e.k") == 1) | (F.size(F.array_intersect("names", "e.names")) >= shared)
    return near.where(hit).select(*keys, "paragraph_index", F.col("e.i").alias("depends_on"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge seen from either end: (node, neighbor, ...)."""
    rest = [c for c in edges.columns if c not in ("source", "target")]
    a = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbor"), *rest)
    b = edges.where("source <> target").select(F.col("target").alias("node"), F.col("source").alias("neighbor"), *rest)
    return a.unionByName(b)


def pair_relations(relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """relations (source, target, signature, valid_at, ...), pairs (a, b), in either order -> the relations between each pair, with a, b and rank by time."""
    asked = pairs.select("a", "b", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    found = relations.withColumn("lo", F.least("source", "target")).withColumn("hi", F.greatest("source", "target")).join(asked, ["lo", "hi"]).drop("lo", "hi")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("a", "b").orderBy("valid_at", "signature")).cast("long"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for edges (u, v) of any comparable type. Labels spread to neighbours and then
    jump to their label's label, so the rounds grow with the logarithm of a component's width."""
    both = shared_table(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).distinct(), "pairs")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component"))
    labels = shared_table(labels, "labels")
    for _ in range(most_rounds):
        spread = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("near"))
        near = labels.join(spread, labels["node"] == spread["u"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        roots = labels.select(F.col("node").alias("r"), F.col("component").alias("further"))
        step = near.join(roots, near["c"] == roots["r"], "left").select("node", "old", F.least("c", F.coalesce("further", "c")).alias("component"))
        step = shared_table(step, "labels")
        drop_shared(labels)
        if step.where("old <> component").limit(1).count() == 0:
            drop_shared(both)
            return step.select("node", "component")
        labels = step.drop("old")
    raise RuntimeError("components: not settled")


def components_within(edges: DataFrame, key: str) -> DataFrame:
    """(key, node, component): as components(), for edges (key, source, target) that never leave a key, such as a book: the edges of one key make one row, whose components are
    found in one step, so that they move once and nothing is stored."""
    end = edges.schema["source"].dataType.simpleString()
    books = edges.groupBy(key).agg(F.collect_set(F.struct("source", "target")).alias("es"))

    def run(batches):
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                at, nodes, labels = [], [], []
                for i, es in enumerate(b.column(1).to_pylist()):
                    root = {}

                    def find(x):
                        while root[x] != x:
                            root[x] = x = root[root[x]]
                        return x

                    for e in es:
                        u, v = e["source"], e["target"]
                        root.setdefault(u, u)
                        root.setdefault(v, v)
                        u, v = find(u), find(v)
                        root[max(u, v)] = min(u, v)  # a root is the smallest of its component
                    at += [i] * len(root)
                    nodes += root
                    labels += map(find, list(root))
                kind = b.schema.field(1).type.value_type.field(0).type
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(nodes, kind), pa.array(labels, kind)], [key, "node", "component"])

    return books.mapInArrow(run, f"{key} {edges.schema[key].dataType.simpleString()}, node {end}, component {end}")


def runs(chapters: DataFrame, key: str, order: str, names: str) -> DataFrame:
    """Maximal runs of consecutive chapters that share a name with the one before: adds run, from 1."""
    w = Window.partitionBy(key).orderBy(order)
    linked = F.arrays_overlap(F.col(names), F.lag(names).over(w))
    return chapters.withColumn("opens", F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("opens").over(w)).drop("opens")


def generations(spark: SparkSession, parents: DataFrame, most_levels: int = 10_000) -> DataFrame:
    """parents (parent, child) -> (node, generation): least distance from a node without parents; cycles without one stay out.

    Level by level: the children of one level that no level before had are the next. Each level is stored, a node once, and a level reads the edges once."""
    edges = shared_table(parents.select("parent", "child").where("parent is not null and child is not null").distinct(), "parents")
    level = edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    done = [shared_table(level.select("node", F.lit(0).cast("long").alias("generation")), "level")]
    for k in range(1, most_levels):
        seen = done[0]
        for d in done[1:]:
            seen = seen.unionByName(d)
        reached = edges.join(done[-1].select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node")).distinct()
        new = shared_table(reached.join(seen.select("node"), "node", "left_anti").select("node", F.lit(k).cast("long").alias("generation")), "level")
        if new.isEmpty():
            return seen
        done.append(new)
        if len(done) > 8:  # few tables, however deep the tree is
            merged = shared_table(seen, "level")
            for d in done[:-1]:
                drop_shared(d)
            done = [merged, new]
    raise RuntimeError("generations: too deep")


def stats(episodes: DataFrame, entities: DataFrame, relations: DataFrame, key: str = "doc_id", most: int = 5) -> DataFrame:
    """What each book's graph holds, as rows (key, section, name, rank, n).

    episodes (key, chapter_index, paragraph_index, names), entities (key, slug, type, mention_count), relations (key, relation_type, state_family, status,
    chapter_index). Sections: count, entity_type, relation_family, top_entity, top_relation_type (ties by name), and for each chapter density_episodes, density_entities, density_relations,
    density_active, density_invalidated."""

    def rows(df: DataFrame, section: str, name: Column | str, n: Column | str, rank: Column | None = None) -> DataFrame:
        name, n = (F.col(c) if isinstance(c, str) else c for c in (name, n))
        return df.select(key, F.lit(section).alias("section"), name.cast("string").alias("name"), (rank if rank is not None else F.lit(0)).cast("long").alias("rank"), n.cast("long").alias("n"))

    def counts(df: DataFrame, **of: Column) -> DataFrame:
        g = df.groupBy(key).agg(*[c.alias(k) for k, c in of.items()])
        return rows(g.select(key, F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("long").alias("n")) for k in of]))), "count", "name", "n")

    def best(df: DataFrame, section: str, name: str, n: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(n), name))
        return rows(df.withColumn("place", place).where(F.col("place") <= most), section, name, n, F.col("place"))

    active, gone = F.count_if(F.col("status") == "active"), F.count_if(F.col("status") == "invalidated")
    by_type = relations.groupBy(key, "relation_type").agg(F.count("*").alias("n"))
    chapters = relations.groupBy(key, "chapter_index").agg(F.count("*").alias("density_relations"), active.alias("density_active"), gone.alias("density_invalidated"))
    of_episodes = episodes.groupBy(key, "chapter_index").agg(F.count("*").alias("density_episodes"), F.size(F.array_distinct(F.flatten(F.collect_list("names")))).alias("density_entities"))
    density = of_episodes.join(chapters, [key, "chapter_index"], "left")
    kinds = ["density_episodes", "density_entities", "density_relations", "density_active", "density_invalidated"]
    density = density.select(key, "chapter_index", F.inline(F.array(*[F.struct(F.lit(k).alias("section"), F.coalesce(F.col(k), F.lit(0)).cast("long").alias("n")) for k in kinds])))
    parts = [
        counts(episodes, chapter_count=F.count_distinct("chapter_index"), episode_count=F.count("*"), max_chapter_index=F.max("chapter_index"), max_paragraph_index=F.max("paragraph_index")),
        counts(entities, entity_count=F.count("*")),
        counts(relations, relation_count=F.count("*"), active_relation_count=active, invalidated_relation_count=gone),
        rows(entities.groupBy(key, "type").agg(F.count("*").alias("n")), "entity_type", "type", "n"),
        rows(relations.groupBy(key, "state_family").agg(F.count("*").alias("n")), "relation_family", "state_family", "n"),
        best(entities, "top_entity", "slug", "mention_count"),
        best(by_type, "top_relation_type", "relation_type", "n"),
        density.select(key, "section", F.col("chapter_index").cast("string").alias("name"), F.lit(0).cast("long").alias("rank"), "n"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _ranked(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= most).drop("place")


def view(entities: DataFrame, relations: DataFrame, chapter: int | None, paragraph: int | None = None, limit: int = 18, from_chapter: int = 0, min_weight: float = 0.0, max_edges: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each book that a reader may be shown. entities (doc_id, slug, mention_count, first_chapter, first_paragraph, last_chapter, chapters), relations (doc_id, source, target, weight, valid_chapter,
    valid_paragraph, chapter_index: that of the chapter which lists it). ``chapter`` None: the whole book.

    The most mentioned entities (six at least) and the ends of all relations shown are the nodes; where that makes more than ``limit``, the most mentioned of them stay,
    and with them the relations between them. Only then weights and ``max_edges`` count."""
    if chapter is None:
        pool, shown = entities, relations
    else:
        pool = entities.where(F.array_contains("chapters", chapter)).where(visible(F.col("first_chapter"), F.col("first_paragraph"), chapter, paragraph))
        shown = relations.where(F.col("chapter_index") == chapter).where(visible(F.col("valid_chapter"), F.col("valid_paragraph"), chapter, paragraph))
    if from_chapter > 0:
        pool, shown = pool.where(F.col("last_chapter") >= from_chapter), shown.where(F.col("valid_chapter") >= from_chapter)
    order = [F.desc("mention_count"), F.col("slug")]
    first = _ranked(pool, ["doc_id"], order, max(6, limit)).select("doc_id", "slug")
    ends = shown.select("doc_id", F.explode(F.array("source", "target")).alias("slug"))
    chosen = first.union(ends).distinct().join(entities.select("doc_id", "slug", "mention_count"), ["doc_id", "slug"])
    nodes = _ranked(chosen, ["doc_id"], order, limit) if limit else chosen
    kept = nodes.select("doc_id", "slug")
    edges = shown.join(kept.withColumnRenamed("slug", "source"), ["doc_id", "source"], "left_semi").join(kept.withColumnRenamed("slug", "target"), ["doc_id", "target"], "left_semi")
    if min_weight > 0:
        edges = edges.where(F.col("weight") >= min_weight)
    if max_edges > 0:
        edges = _ranked(edges, ["doc_id"], [F.desc("weight"), F.col("source"), F.col("target")], max_edges)
    return nodes, edges


def visible(chapter: Column, paragraph: Column, max_chapter: int, max_paragraph: int | None = None) -> Column:
    """The spoiler gate, in plain comparisons so that it reaches the scan."""
    if max_paragraph is None:
        return chapter <= max_chapter
    return (chapter < max_chapter) | ((chapter == max_chapter) & (paragraph <= max_paragraph))
