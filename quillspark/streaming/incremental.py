"""Incremental builds and live state with Structured Streaming.

The batch operators stay the definition; a stream brings the tables up to date. A book's state is re-derived for the keys that a
micro-batch touches, so late and repeated chunks give what a fresh build would."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.sources.stores import exists


#: Books are stored in so many directories, so that a batch reads those that its books are in; the more books, the more of them.
BUCKETS = 64


def bucket_of(book: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(book), F.lit(buckets)).cast("int")


class EpochLog:
    """Rows by epoch and bucket, one directory each, and a base that holds what earlier epochs have come to. A compaction writes a new base, then names it the current one; from then on the epochs in it
    don't count, so that a crash in between loses and doubles nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def append(self, rows: DataFrame, epoch: int) -> None:
        """Adds an epoch's rows (with bucket). An epoch replaces itself on a retry, so a batch counts once."""
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/epochs/epoch={epoch}")

    def base(self) -> int:
        """The last epoch in the current base, -1 without one."""
        at = f"{self.root}/current"
        return self.spark.read.schema("upto long").json(at).first()["upto"] if exists(self.spark, at) else -1

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """All rows with their epoch (of the given buckets alone)."""
        upto, parts = self.base(), []
        if upto >= 0:
            parts.append(self.spark.read.parquet(f"{self.root}/base/upto={upto}"))
        if exists(self.spark, f"{self.root}/epochs"):
            parts.append(self.spark.read.parquet(f"{self.root}/epochs").where(F.col("epoch") > upto).withColumn("epoch", F.col("epoch").cast("long")))
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return rows if buckets is None else rows.where(F.col("bucket").isin(*buckets))

    def compact(self, now: DataFrame, upto: int) -> None:
        """Makes ``now`` (rows with epoch and bucket, of epochs up to ``upto``) the base, and deletes what it replaces."""
        old = self.base()
        now.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/base/upto={upto}")
        self.spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("overwrite").json(f"{self.root}/current")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if old >= 0 and old != upto:
            files.delete(path(f"{self.root}/base/upto={old}"), True)
        if exists(self.spark, f"{self.root}/epochs"):
            for status in files.listStatus(path(f"{self.root}/epochs")):
                name = status.getPath().getName()
                if name.startswith("epoch=") and int(name[6:]) <= upto:
                    files.delete(status.getPath(), True)


def _first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The earliest epoch's row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("epoch"))
    return rows.withColumn("k", place).where("k = 1").drop("k")


def _last(rows: DataFrame, book: str) -> DataFrame:
    """All rows of each book's last epoch."""
    last = F.max("epoch").over(Window.partitionBy(book))
    return rows.withColumn("last", last).where("epoch = last").drop("last")


def incremental_build(chunks: DataFrame, root: str, checkpoint: str, derive: Callable[[DataFrame], DataFrame], book: str = "doc_id", keys: tuple[str, ...] = ("doc_id", "paragraph_index"), buckets: int = BUCKETS, compact_every: int = 16) -> StreamingQuery:
    """chunks: a stream. Keeps ``root/chunks`` and, under ``root/derived``, derive(all chunks of a book) for each book that has changed. Every ``compact_every`` epochs both are compacted."""

    def batch(new: DataFrame, epoch: int) -> None:
        spark = new.sparkSession
        log, out = EpochLog(spark, f"{root}/chunks"), EpochLog(spark, f"{root}/derived")
        touched = new.select(book, bucket_of(book, buckets).alias("bucket")).distinct().persist()
        of = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # a number a directory
        if of:
            log.append(new.dropDuplicates(list(keys)).withColumn("bucket", bucket_of(book, buckets)), epoch)
            whole = _first(log.read(of), list(keys)).drop("epoch", "bucket").join(touched.select(book), book, "left_semi")
            out.append(derive(whole).withColumn("bucket", bucket_of(book, buckets)), epoch)
        touched.unpersist()
        if compact_every and epoch % compact_every == compact_every - 1:
            compact(spark, root, epoch, book, keys)

    return chunks.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def compact(spark: SparkSession, root: str, epoch: int, book: str = "doc_id", keys: tuple[str, ...] = ("doc_id", "paragraph_index")) -> None:
    """Brings chunks and derived rows of all epochs up to this one into one directory a bucket."""
    for name, now in (("chunks", lambda rows: _first(rows, list(keys))), ("derived", lambda rows: _last(rows, book))):
        log = EpochLog(spark, f"{root}/{name}")
        rows = log.read()
        if rows is not None:
            log.compact(now(rows.where(F.col("epoch") <= epoch)), epoch)


def derived(spark: SparkSession, root: str, book: str = "doc_id") -> DataFrame:
    """The last derivation of each book."""
    rows = EpochLog(spark, f"{root}/derived").read()
    if rows is None:
        raise FileNotFoundError(root)
    return _last(rows, book).drop("epoch", "bucket")


def latest_state(events: DataFrame, job: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each job by ``order``."""
    return events.groupBy(job).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("x"), F.count("*").alias("n_events")).select(job, "x.*", "n_events")


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "2 days", ts: str = "ts") -> DataFrame:
    """Counts and sums by window and type, with a watermark for streams (an extension: event time has no counterpart to match)."""
    w = F.window(ts, width)
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, user: str, gap: str, ts: str = "ts") -> DataFrame:
    """Sessions of each user: events with no more than the gap between them."""
    g = events.groupBy(user, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n"))
    return g.select(user, F.col("s.start").alias("start"), "n")


def progress_percent(done: Column, total: Column) -> Column:
    return F.floor(F.least(F.lit(1.0), F.try_divide(done, total)) * 100)
