"""Segments of sealed records as gzip JSON lines, with manifests that bind content and order; torn tails are told, not hidden.

A segment is a folder of one file, ``segment=<key>-<no>``. Manifests are committed last, in a folder that data readers
skip (``_manifests``): a write that fails half way leaves segments that no manifest knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import chains


def read_segments(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every line with its file; ``corrupt`` holds the text of a line that is no whole record, as a torn tail leaves it."""
    wide = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("corrupt", T.StringType())])
    lines = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("_path"), "value")
    parsed = lines.select("file", F.regexp_extract("_path", "segment=([^/]*)/", 1).alias("segment"), F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("r"))
    return parsed.select("file", "segment", "r.*")


def write_segments(records: DataFrame, path: str, key: str, order: list[str], at: str, content: Column, most_records: int, most_bytes: int, most_age: int) -> DataFrame:
    """Writes ``records`` as segments cut by ``chains.rotated``, each record sealed with ordinal, prev and digest; returns the manifests, committed last.

    ``content`` is the text of a record that its digest covers; its bytes count for ``most_bytes``.
    """
    cut = chains.rotated(records.withColumn("content", content), key, order, at, F.octet_length("content"), most_records, most_bytes, most_age)
    named = cut.withColumn("segment", F.concat_ws("-", F.coalesce(F.col(key).cast("string"), F.lit("")), F.format_string("%08d", F.col("segment_no")))).withColumnRenamed("place", "ordinal").drop("segment_no")
    chains.sealed(named).write.mode("errorifexists").option("compression", "gzip").partitionBy("segment").json(path)
    return commit(records.sparkSession, path)


_SEALED = "ordinal long, prev string, digest string, content string"


def commit(spark: SparkSession, path: str) -> DataFrame:
    """Manifests of the segments that are there, written and read back."""
    rows = read_segments(spark, path, _SEALED).where("corrupt IS NULL")
    chains.manifests(rows).write.mode("errorifexists").json(f"{path}/_manifests")
    return committed(spark, path)


def committed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("segment string, records long, first_digest string, last_digest string, root string").json(f"{path}/_manifests")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """``chains.verified`` of what the files hold against the committed manifests, and the torn lines of each segment."""
    lines = read_segments(spark, path, _SEALED)
    torn = lines.groupBy("segment").agg(F.count("corrupt").alias("torn"))
    return chains.verified(lines.where("corrupt IS NULL"), committed(spark, path)).join(torn, "segment", "left").fillna({"torn": 0})
