"""URL filters (operator 9): host-suffix and path-prefix rules by hash prefixes.

The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased in A-Z; the path goes on from there up
to ``?`` or ``#``. Without ``://``, or if the url is null, both are empty. A rule (host, path, verdict) fits its host and all its
subdomains, if the url's path starts with the rule's. The longest rule that fits wins; of two verdicts for the
same rule, block. Urls that no rule fits get ``default``.

Each distinct (host, path) expands into host-suffix x path-prefix expressions, no longer than the rules' longest; they meet the rules
in an equi-join on four bytes of their SHA-256, and the full digest confirms. All of it is DataFrame functions. The
rules are broadcast only where their number, counted, is at most ``broadcast_rules``; otherwise the join shuffles. A url of very many pages is judged
in up to ``SALTS`` parts, by a hash of the page's id, so that no task gets all of them.
Rules with a null host are left out, a null path is empty. Repeated pages are each reported, ids may be null, very long urls are judged whole, an empty table gives an empty result; other columns,
whatever they are called, are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import quoted, table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
BROADCAST_RULES = 50_000
SALTS = 64
_PREFIX_HEX = 8


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after(url), r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _digested(df: DataFrame) -> DataFrame:
    return df.withColumn("digest", F.sha2(F.col("expression").cast("binary"), 256)).withColumn("short", F.substring("digest", 1, _PREFIX_HEX))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """rules (host, path, verdict) -> (page id, host, path, rule, verdict), one row a page."""
    rules = rules.where("host is not null").select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = _digested(rules.select(F.concat("host", "path").alias("expression"), "host", "path", "verdict"))
    per_rule = rules.groupBy("short", "digest", F.col("expression").alias("rule")).agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict"))["verdict"].alias("verdict"))
    whole = ~F.endswith("path", F.lit("/")) & (F.col("path") != "")
    bound = rules.agg(
        F.max(F.size(F.split("host", r"\."))).alias("labels"),
        F.max(F.length("path")).alias("longest"),
        F.collect_set(F.when(whole, F.length("path"))).alias("lengths"),  # distinct lengths only
        F.count("*").alias("n"),
    ).first()
    page, url = F.col(quoted(id_col)), F.col(quoted(url_col))
    urls = pages.select(page.alias("id"), F.pmod(F.xxhash64(page), F.lit(SALTS)).alias("salt"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = urls.select("id", "salt", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    if not bound["n"]:
        return urls.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    labels, n = F.split("host", r"\."), F.lit(bound["labels"])
    count = F.size(labels)
    first = F.greatest(F.lit(1), count - n + 1)
    suffixes = F.transform(F.sequence(first, count), lambda i: F.array_join(F.slice(labels, i, count), "."))
    longest = F.least(F.length("path"), F.lit(bound["longest"]))
    places = F.filter(F.sequence(F.lit(1), longest), lambda i: F.substring(F.col("path"), i, F.lit(1)) == "/")
    places = F.when(longest > 0, places).otherwise(F.array().cast("array<int>"))
    exact = F.filter(F.array(F.lit(0), *[F.lit(x) for x in sorted(bound["lengths"])]), lambda i: i <= F.length("path"))
    prefixes = F.transform(F.array_distinct(F.concat(places, exact)), lambda i: F.substring(F.col("path"), F.lit(1), i))

    key = ["host", "path", "salt"]
    distinct = urls.where("host <> ''").groupBy(*key).agg(F.lit(1).alias("one"))
    expressions = distinct.select(*key, F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select(*key, "suffix", F.explode("prefixes").alias("prefix"))
    expressions = _digested(expressions.select(*key, F.concat("suffix", "prefix").alias("expression"))).drop("expression")
    known = F.broadcast(per_rule) if bound["n"] <= broadcast_rules else per_rule
    met = expressions.join(known, "short").where(expressions["digest"] == per_rule["digest"])
    best = met.groupBy(*key).agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict")).alias("best"))
    best = best.select(*key, "best.rule", "best.verdict")
    judged = urls.where("host <> ''").join(best, key, "left").select("id", "host", "path", "rule", "verdict")
    empty = urls.where("host = ''").select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    both = judged.unionByName(empty)
    return both.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


OP9_SQL = """
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r(rhost, rpath, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, v,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
