"""Registration of queries, and the views of the driver tables that many of them start from."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import put_on_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that gives the same rows."""

    def put(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            put_on_path(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> F.Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ticks: key, id, t (microseconds), cents (whole), type."""
    cents = F.round(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), micros("ts").alias("t"), cents.alias("cents"), F.col("event_type").alias("type"))


TICKS = "ticks AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS t, CAST(round(value * 100) AS BIGINT) AS cents, event_type AS type FROM events)"


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with documents as forecasts: id, p (in thousandths, whole), y (0 or 1), toxic, lang, source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    p = F.pmod(F.col("n_chars") * 37 + F.col("doc_id") * 11, F.lit(1001))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), p.cast("long").alias("p"), F.col("quality").cast("long").alias("y"), "toxic", "lang", "source")


FORECASTS = "forecasts AS (SELECT doc_id AS id, CAST((n_chars * 37 + doc_id * 11) % 1001 AS BIGINT) AS p, CAST(quality AS BIGINT) AS y, toxic, lang, source FROM labels JOIN documents USING (doc_id))"
