"""Views that let the engine's operators run on the driver tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T

CHAPTER_PARAGRAPHS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its files give fewer tasks than there are cores: text functions cost far more than moving so small an
    input once. A table of many files or row groups is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if tasks < cores and tasks * 4 <= cores else df


def paragraphs(spark: SparkSession, sf_dir: str, by_book: bool = False) -> DataFrame:
    """(doc_id, chapter_index, paragraph_index, text): non-blank lines of documents, eight to a chapter.

    by_book: for plans that go on by book. The texts move once, each book to one task, and what is made of them stays there: groups, windows and joins within a
    book need no further exchange, and branches of one plan share this one."""
    lines = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: x != "")
    books = table(spark, sf_dir, "documents").select("doc_id", "text")
    books = books.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id") if by_book else spread(books)
    out = books.select("doc_id", F.posexplode(lines).alias("pos", "text"))
    at = (F.col("pos") + 1).cast("long")
    return out.select("doc_id", (F.floor(F.col("pos") / CHAPTER_PARAGRAPHS) + 1).alias("chapter_index"), at.alias("paragraph_index"), "text")


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


P_CTE = rf"""p AS (
  SELECT doc_id, (i - 1) // 8 + 1 AS chapter_index, i AS paragraph_index, t AS text FROM (
    SELECT doc_id, unnest(ls) AS t, unnest(range(1, len(ls) + 1)) AS i FROM (
      SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS ls FROM documents)))"""


def mentions(spark: SparkSession, sf_dir: str, by_book: bool = True) -> DataFrame:
    """(doc_id, chapter_index, paragraph_index, ord, name): candidate names of each paragraph, in order of appearance.

    They are found where a book is read and move once, a book's in one value to one task. All branches of a plan read both columns of that
    exchange, so they share it, and what they do within a book needs no other. by_book False: for plans that store them, without that exchange."""
    lines = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: x != "")
    books = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.transform(lines, lambda x: T.candidate_names(x)).alias("names"))
    books = T.made_once(books, "names")
    books = books.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id") if by_book else books
    p = books.select("doc_id", F.posexplode("names").alias("line", "names"))
    p = p.select("doc_id", (F.floor(F.col("line") / CHAPTER_PARAGRAPHS) + 1).alias("chapter_index"), (F.col("line") + 1).cast("long").alias("paragraph_index"), "names")
    return p.select("doc_id", "chapter_index", "paragraph_index", F.posexplode("names").alias("pos", "name")).select(
        "doc_id", "chapter_index", "paragraph_index", (F.col("pos") + 1).cast("long").alias("ord"), "name"
    )


#: Distinct candidate names of a text, in order of appearance, at most five.
SQL_NAMES = r"""list_filter(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[A-Z][a-z]{{2,}}$') AND x NOT IN ('Chapter', 'When', 'The', 'By', 'At'))"""

M_CTE = rf"""{P_CTE},
m0 AS (SELECT doc_id, chapter_index, paragraph_index, unnest(ns) AS name, unnest(range(1, len(ns) + 1)) AS i FROM (
  SELECT *, {SQL_NAMES.format('text')} AS ns FROM p)),
m1 AS (SELECT doc_id, chapter_index, paragraph_index, name, min(i) AS i FROM m0 GROUP BY ALL),
m AS (SELECT doc_id, chapter_index, paragraph_index, name, row_number() OVER (PARTITION BY doc_id, paragraph_index ORDER BY i) AS ord
  FROM m1 QUALIFY row_number() OVER (PARTITION BY doc_id, paragraph_index ORDER BY i) <= 5)"""


def star_edges(spark: SparkSession, sf_dir: str, asked: str = "true") -> DataFrame:
    """Orders and their lines as facts: customer (source) deals with supplier (target) from the ship date on. asked: a condition on orders."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_quantity", "l_discount")
    orders = table(spark, sf_dir, "orders").where(asked).select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lines.join(orders, "l_orderkey").select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("source"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("target"),
        F.concat(F.lit("p"), F.col("l_partkey")).alias("part"),
        F.lit("MEMBER_OF").alias("relation_type"),
        F.lit("membership").alias("state_family"),
        F.col("l_shipdate").alias("valid_at"),
        "l_orderkey",
        F.col("l_linenumber").cast("long").alias("l_linenumber"),
        "l_suppkey",
        "l_partkey",
        F.col("l_discount").alias("confidence"),
    )


E_CTE = """e AS (
  SELECT 'c' || o_custkey AS source, 's' || l_suppkey AS target, 'p' || l_partkey AS part, 'MEMBER_OF' AS relation_type, 'membership' AS state_family,
    l_shipdate AS valid_at, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, l_partkey, l_discount AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

ORD = ["valid_at", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]
ORD_SQL = ", ".join(ORD)
