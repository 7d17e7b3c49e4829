"""Watermarked windows over tick streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ohlc_stream(ticks: DataFrame, seconds: int, late: str) -> DataFrame:
    """Tumbling open, high, low, close and count per key; ticks later than ``late`` are dropped by the watermark.

    ticks: key, id, ts (timestamp), cents. State per key and open bucket only.
    """
    order = F.struct("ts", "id")
    w = F.window("ts", f"{seconds} seconds")
    return (
        ticks.withWatermark("ts", late).where("cents IS NOT NULL").groupBy("key", w.alias("w"))
        .agg(F.min_by("cents", order).alias("open"), F.max("cents").alias("high"), F.min("cents").alias("low"), F.max_by("cents", order).alias("close"), F.count("*").alias("tick_count"))
        .select("key", F.col("w.start").alias("bucket"), "open", "high", "low", "close", "tick_count")
    )


def sliding_counts(ticks: DataFrame, length: str, slide: str, late: str) -> DataFrame:
    """Rows per sliding window and type."""
    return ticks.withWatermark("ts", late).groupBy(F.window("ts", length, slide).alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def session_stream(ticks: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions per key that end after ``gap`` without ticks."""
    return ticks.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def redeliveries_dropped(artifacts: DataFrame, late: str) -> DataFrame:
    """The first of each delivery within the watermark."""
    return artifacts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["delivery"])
