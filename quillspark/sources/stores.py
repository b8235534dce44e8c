"""Stores: books, graphs, memory indexes and build logs as Parquet tables, a directory for each version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_table(df: DataFrame, root: str, name: str, by: str = "doc_id") -> None:
    """Replaces the partitions that df has, and leaves those of other books."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{root}/{name}")


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ensure_table(spark: SparkSession, root: str, name: str, build, by: str = "doc_id") -> DataFrame:
    """The stored table; built and stored first if it isn't there."""
    if not exists(spark, f"{root}/{name}"):
        save_table(build(), root, name, by)
    return load_table(spark, root, name)


def list_books(books: DataFrame) -> DataFrame:
    return books.select("book_id", "title").distinct().orderBy("book_id")


def save_graph(tables: dict[str, DataFrame], root: str, version: str) -> None:
    """One table for each kind of node and edge under a directory of this version; older versions stay."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{version}/{name}")


def load_graph(spark: SparkSession, root: str, version: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{version}/{n}") for n in names}


def graph_metadata(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): what a graph holds, from the files' footers alone."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def append_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def publish(spark: SparkSession, root: str, version: str) -> None:
    """Makes a version the current one. Versions are never written over, so the ones before stay readable."""
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{root}/current")


def current_version(spark: SparkSession, root: str) -> str | None:
    return spark.read.schema("version string").json(f"{root}/current").first()["version"] if exists(spark, f"{root}/current") else None


#: The tables of a memory index, and of the graph and book below it.
MEMORY_TABLES = ("status", "entities", "memories", "documents")


def save_index(index: dict[str, DataFrame], root: str, version: str) -> None:
    """A memory index: one table of each kind, a partition a book, under its version; the status table names the version, so that a reader can tell."""
    missing = [t for t in MEMORY_TABLES if t not in index]
    if missing:
        raise ValueError(f"an index has {', '.join(MEMORY_TABLES)}; {', '.join(missing)} missing")
    for name in MEMORY_TABLES:
        df = index[name].withColumn("memory_version", F.lit(version)) if name == "status" else index[name]
        save_table(df, f"{root}/indexes/{version}", name)


def load_index(spark: SparkSession, root: str, version: str) -> dict[str, DataFrame]:
    return {n: load_table(spark, f"{root}/indexes/{version}", n) for n in MEMORY_TABLES}


def ensure_index(spark: SparkSession, root: str, version: str, books: DataFrame, build) -> dict[str, DataFrame]:
    """The index of at least ``books`` (doc_id): ``build``(missing books) makes and stores what isn't there yet, and nothing else."""
    missing = books.select("doc_id").distinct()
    if exists(spark, f"{root}/indexes/{version}/status"):
        have = load_index(spark, root, version)["status"].select("doc_id").distinct()
        missing = missing.join(have, "doc_id", "left_anti")
    if not missing.isEmpty():
        save_index(build(missing), root, version)
    return load_index(spark, root, version)


def retrieval_documents(index: dict[str, DataFrame], doc_id: int | None = None) -> DataFrame:
    """The retrieval part of an index; of one book only its partition is read."""
    return index["documents"] if doc_id is None else index["documents"].where(F.col("doc_id") == doc_id)


def archive_graph(spark: SparkSession, root: str, graph: str, version: str, stamp: str) -> str | None:
    """Moves the graph's folder to archive/graphs_legacy/<stamp> unless its metadata name ``version`` as both graph and memory version. Returns where it went, None if it stays or there is none.

    metadata.json in the folder: {graph_version, memory_version}; one that can't be read is legacy."""
    at = f"{root}/graphs/{graph}"
    if not exists(spark, at):
        return None
    if exists(spark, f"{at}/metadata.json"):
        m = spark.read.schema("graph_version string, memory_version string").json(f"{at}/metadata.json").first()
        if m is not None and m["graph_version"] == version and m["memory_version"] == version:
            return None
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    to = f"{root}/archive/graphs_legacy/{stamp}"
    files.mkdirs(path(to))
    if not files.rename(path(at), path(f"{to}/{graph}")):
        raise OSError(f"could not move {at}")
    return f"{to}/{graph}"


def open_books(spark: SparkSession, root: str, version: str, books, graph, index) -> dict[str, dict[str, DataFrame]]:
    """Book, graph and memory tables, each built from the ones before where it isn't stored yet: books() -> {name: table}, graph(books) -> {name: table}, index(books, graph) -> memory tables."""
    out: dict[str, dict[str, DataFrame]] = {}
    for kind, build in (("books", lambda: books()), ("graphs", lambda: graph(out["books"])), ("memory", lambda: index(out["books"], out["graphs"]))):
        at = f"{root}/{kind}/{version}"
        if not exists(spark, f"{at}/_done"):
            tables = build()
            for name, df in tables.items():
                df.write.mode("overwrite").parquet(f"{at}/{name}")
            spark.createDataFrame([(n,) for n in sorted(tables)], "name string").coalesce(1).write.mode("overwrite").json(f"{at}/_done")
        names = [r["name"] for r in spark.read.schema("name string").json(f"{at}/_done").collect()]
        out[kind] = {n: spark.read.parquet(f"{at}/{n}") for n in names}
    return out
