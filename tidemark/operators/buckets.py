"""Epoch-aligned buckets and latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_start(t: Column, seconds: int) -> Column:
    """The start of the epoch-aligned bucket that holds t (microseconds)."""
    return t - F.pmod(t, F.lit(seconds * 1_000_000))


def ohlc(ticks: DataFrame, seconds: int, value: str = "cents") -> DataFrame:
    """Open, high, low, close, mean and count per key and bucket; open and close by (t, id); rows without a value are skipped.

    All are decomposable, so each task's rows are combined before the one shuffle by key and bucket.
    """
    v, order = F.col(value), F.struct("t", "id")
    return (
        ticks.where(v.isNotNull()).groupBy("key", bucket_start(F.col("t"), seconds).alias("bucket"))
        .agg(F.min_by(v, order).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, order).alias("close"), (F.sum(v) / F.count(v)).alias("mean"), F.count(v).alias("tick_count"))
    )


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The row with the highest order per key, by max_by: combined before the shuffle, no window."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("row")).select(*keys, "row.*")


def hour_coverage(ticks: DataFrame, buckets: DataFrame) -> DataFrame:
    """Per key: hours with ticks, how many of them have a bucket, and the share."""
    hour = lambda c: (F.col(c) - F.pmod(F.col(c), F.lit(3_600_000_000))).alias("hour")
    raw, had = ticks.select("key", hour("t")).distinct(), buckets.select("key", hour("bucket")).distinct().withColumn("had", F.lit(1))
    return raw.join(had, ["key", "hour"], "left").groupBy("key").agg(F.count("*").alias("raw_hours"), F.count("had").alias("covered_hours"), (F.count("had") / F.count("*")).alias("coverage"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same keys; new keys are added. ``new`` has one row per key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def ohlc_known(rows: DataFrame, seconds: int, value: str, others: list[str]) -> DataFrame:
    """Buckets of a value that may be null: open, high, low and close of the known ones, and of each other column its last known value, least, largest and mean."""
    def ends(v: str) -> Column:
        return F.when(F.col(v).isNotNull(), F.struct("t", "id"))

    aggregates = [F.count("*").alias("n"), F.min_by(value, ends(value)).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, ends(value)).alias("close")]
    for v in others:
        aggregates += [F.max_by(v, ends(v)).alias(f"last_{v}"), F.min(v).alias(f"min_{v}"), F.max(v).alias(f"max_{v}"), F.round(F.avg(v), 4).alias(f"avg_{v}")]
    return rows.groupBy("key", bucket_start(F.col("t"), seconds).alias("bucket")).agg(*aggregates)
