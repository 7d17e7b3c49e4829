"""Sinks that commit a micro-batch once: staged, swapped in by partitions, then entered in a ledger.

A batch that is replayed after a failure finds how far it had come. Its result is staged once, from the table as it
was, so a half-done swap is finished from the same rows and nothing is merged twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.buckets import bucket_start

#: Bars that merge: what orders an open and a close is kept beside them.
BARS = "key long, bucket long, first_t long, first_id long, open long, high long, low long, last_t long, last_id long, close long, total long, n long"


def bars(ticks: DataFrame, seconds: int) -> DataFrame:
    """Partial bars of ticks (key, id, t, cents) with a known value; ``merged`` puts partial bars of one bucket together."""
    own = ticks.where("cents IS NOT NULL").select("key", bucket_start(F.col("t"), seconds).alias("bucket"), "t", "id", "cents")
    one = own.select("key", "bucket", F.col("t").alias("first_t"), F.col("id").alias("first_id"), F.col("cents").alias("open"), F.col("cents").alias("high"), F.col("cents").alias("low"), F.col("t").alias("last_t"), F.col("id").alias("last_id"), F.col("cents").alias("close"), F.col("cents").alias("total"), F.lit(1).cast("long").alias("n"))
    return merged(one)


def merged(parts: DataFrame) -> DataFrame:
    """One bar per key and bucket of partial bars, in whatever order and grouping these were made."""
    first, last = F.struct("first_t", "first_id", "open"), F.struct("last_t", "last_id", "close")
    by = parts.groupBy("key", "bucket").agg(F.min(first).alias("f"), F.max("high").alias("high"), F.min("low").alias("low"), F.max(last).alias("l"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    return by.select("key", "bucket", "f.first_t", "f.first_id", "f.open", "high", "low", "l.last_t", "l.last_id", "l.close", "total", "n")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def committed_batches(spark: SparkSession, table: str) -> DataFrame:
    """(batch, part, n): which partitions each finished batch replaced, and with how many rows."""
    rows = spark.read.schema("batch long, part string, n long")
    return rows.json(f"{table}/_ledger") if _exists(spark, f"{table}/_ledger") else spark.createDataFrame([], "batch long, part string, n long")


def commit_batch(table: str, partition: str, merge: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: folds a batch's rows into the Parquet ``table`` (a folder), whose partitions they touch are rewritten.

    ``merge`` makes one table of old and new rows, of which it is given those of the touched partitions. Steps: skip if the
    ledger has the batch; stage the merged partitions, unless they are staged whole; swap them in by a dynamic partition
    overwrite, which may be done again; enter the batch in the ledger. A batch without rows is only entered.
    """

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if committed_batches(spark, table).where(F.col("batch") == number).limit(1).count():
            return
        staged = f"{table}/_staging/batch={number}"
        if not _exists(spark, f"{staged}/_SUCCESS"):
            rows = batch
            if _exists(spark, table) and spark.read.schema(batch.schema).parquet(table).limit(1).count():
                old = spark.read.schema(batch.schema).parquet(table)
                rows = old.join(batch.select(partition).distinct(), partition, "left_semi").select(batch.columns).unionByName(batch)
            merge(rows).write.mode("overwrite").parquet(staged)
        new = spark.read.schema(batch.schema).parquet(staged)
        if new.limit(1).count():
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(table)
        parts = new.groupBy(F.col(partition).cast("string").alias("part")).agg(F.count("*").alias("n"))
        entry = parts.select(F.lit(number).cast("long").alias("batch"), "part", "n")
        none = spark.createDataFrame([(number, None, 0)], "batch long, part string, n long")
        (entry if new.limit(1).count() else none).coalesce(1).write.mode("append").json(f"{table}/_ledger")

    return commit


def merge_bars(partition: str = "day", per: int = 86_400_000_000) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: merged(rows).withColumn(partition, F.floor(F.col("bucket") / per))


def bars_by_day(ticks: DataFrame, seconds: int) -> DataFrame:
    """What ``commit_batch`` with ``merge_bars`` takes of a batch of ticks."""
    return merge_bars()(bars(ticks, seconds))
