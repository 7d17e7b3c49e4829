"""The corpus pipeline: toxic documents go, copies go, near copies go, secrets are masked, the rest is packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import new_name, written
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.near_dedup import near_dedup
from tidemark.llm.packing import pack
from tidemark.llm.secrets import redact
from tidemark.llm.toxicity import fit_toxicity, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not reject; it is fitted on a bounded sample of labels.

    Null and empty texts get what the model's cuts alone say; rows without a doc_id and repeated rows are judged each.
    An empty table gives no rows.
    """
    return without_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _without(docs: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` without the rows that ``decide`` does not keep.

    A doc_id may be null or repeated, so each row gets a number of its own in a written table, and
    ``decide`` has it as doc_id. Numbers ascend by doc_id (nulls last), then by place; so the smallest
    number has the smallest doc_id.
    """
    row = new_name(docs, "row")
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    rows = written(placed.orderBy(F.col("doc_id").cast("long").asc_nulls_last(), row).withColumn(row, F.monotonically_increasing_id()), "rows")
    gone = decide(rows.select(F.col(row).alias("doc_id"), "text")).where("not kept").select(F.col("doc_id").alias(row))
    return rows.join(gone, row, "left_anti").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the first row by doc_id; null and empty texts are equal, rows without a doc_id come last. An empty table gives no rows."""
    return _without(docs, exact_dedup)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: the first by doc_id, rows without one last; texts without words are kept. An empty table gives no rows."""
    return _without(docs, lambda rows: near_dedup(rows, percent=80))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; null texts stay null, repeated rows and rows without a doc_id are masked each. An empty table gives no rows."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; a null or empty text is its end id, repeated rows are packed each. An empty table gives no rows."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("secrets", secrets), ("packing", packing)]

#: The tokenizer and the fitted model are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over all of ``documents``; what a stage keeps is written for the next one. Odd rows: see the stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
