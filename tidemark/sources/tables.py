"""Tables: schema-checked metrics, partition overwrites by natural key, file statistics, backups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.buckets import upsert


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def validated(rows: DataFrame, checks: dict[str, F.Column]) -> DataFrame:
    """Rows with ``invalid``, the names of the checks that do not hold (or are unknown)."""
    return rows.withColumn("invalid", F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull()))


def append_lines(rows: DataFrame, path: str) -> None:
    """Appends rows as JSON lines."""
    rows.write.mode("append").json(path)


def upsert_partitions(spark: SparkSession, path: str, new: DataFrame, keys: list[str], partition: str, staging: str) -> None:
    """Rewrites only the partitions that ``new`` touches, with its rows in place of those with the same keys.

    The result is staged first, as a job can't read what it overwrites; a rerun gives the same table.
    """
    touched = new.select(partition).distinct()
    old = spark.read.parquet(path).join(touched, partition, "left_semi")
    upsert(old.select(new.columns), new, keys).write.mode("overwrite").parquet(staging)
    spark.read.parquet(staging).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def prune(spark: SparkSession, paths: dict[str, str], fates: dict[str, DataFrame], partition: dict[str, str], staging: str) -> dict[str, int]:
    """Removes what ``retention.cascade`` says goes, table by table, children first; returns the rows removed.

    What stays of the touched partitions is staged for all tables before the first is rewritten, as the fates are read from the
    tables themselves. A partition of which nothing stays is removed. After a failure the run is repeated on what is
    there: a child's rows that are gone are gone, and no parent goes before its children.
    """
    gone = {n: F.col("fate").isin("deleted", "cascaded") for n in fates}
    for name, df in fates.items():
        df.where(gone[name]).groupBy(partition[name]).agg(F.count("*").alias("removed")).write.mode("overwrite").parquet(f"{staging}/{name}/touched")
        touched = spark.read.parquet(f"{staging}/{name}/touched").select(partition[name])
        df.join(touched, partition[name], "left_semi").where(~gone[name]).drop("fate").write.mode("overwrite").parquet(f"{staging}/{name}/kept")
    removed = {}
    for name, path in paths.items():
        touched, kept = (spark.read.parquet(f"{staging}/{name}/{x}") for x in ("touched", "kept"))
        removed[name] = touched.agg(F.sum("removed")).first()[0] or 0
        if removed[name]:
            for r in touched.select(partition[name]).join(kept.select(partition[name]).distinct(), partition[name], "left_anti").toLocalIterator():
                _remove(spark, f"{path}/{partition[name]}={r[0]}")
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition[name]).parquet(path)
    return removed


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def file_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Files, bytes and rows of a table, from the files' metadata column."""
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.first("_metadata.file_size").alias("bytes"))
    return files.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))


def checksums(rows: DataFrame, columns: list[str], parts: int = 64) -> DataFrame:
    """Order-free checksums of a table by parts of its rows' hashes, to hold a copy against."""
    h = F.xxhash64(*columns)
    return rows.groupBy(F.pmod(h, F.lit(parts)).alias("part")).agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("total"))


def fixtures(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files with the digest they should have (file, sha256) and the one they have; ``state``: ok, changed, missing or unknown."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when(F.col("found") == F.col("sha256"), "ok").otherwise("changed")
    return expected.join(found, "file", "full").withColumn("state", state)
