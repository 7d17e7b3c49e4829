"""Import of older files into a governed table: each file once, by its content, and whole or not at all."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import put_on_path

LEDGER = "digest string, file string, bytes long, records long, state string, reason string"
_LINES = "digest string, file string, bytes long, ordinal long, line string, fault string"


def _text(content: bytes) -> tuple[bytes, str | None]:
    """The bytes of a plain or gzip file, as far as they can be read, and what is wrong with it."""
    if content[:2] != b"\x1f\x8b":
        return content, None
    out = b""
    while content[:2] == b"\x1f\x8b":  # members may follow one another
        part = zlib.decompressobj(31)
        try:
            out += part.decompress(content)
        except zlib.error:
            return out, "damaged"
        if not part.eof:
            return out, "torn"
        content = part.unused_data
    return out, "trailing_bytes" if content else None


def file_lines(files: DataFrame) -> DataFrame:
    """Lines of ``files`` (digest, file, bytes, content), each file read whole by one task; a file without lines, or a fault, is one row without a line."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for digest, file, size, content in zip(rows["digest"], rows["file"], rows["bytes"], rows["content"], strict=True):
                data, fault = _text(bytes(content))
                try:
                    lines = data.decode().split("\n")
                except UnicodeDecodeError:
                    lines, fault = [], fault or "not_utf8"
                if lines and lines[-1] == "":
                    lines.pop()
                elif lines and fault is None and lines[-1]:
                    fault = "no_last_newline"
                lines = lines or [None]
                yield pd.DataFrame({"digest": digest, "file": file, "bytes": size, "ordinal": range(len(lines)), "line": lines, "fault": fault})

    put_on_path(files.sparkSession)
    return files.mapInPandas(read, _LINES)


def scan(spark: SparkSession, source: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records of the files below ``source``, and a row per distinct content: records, bytes, and the first fault, if any.

    A record that doesn't fit ``schema`` is a fault of its file. Files of equal content are one, by its first name.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    files = found.select(F.sha2("content", 256).alias("digest"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), "content")
    names = files.groupBy("digest").agg(F.min("file").alias("file"), F.first("bytes").alias("bytes"))
    contents = files.dropDuplicates(["digest"]).drop("file", "bytes").join(names, "digest").select("digest", "file", "bytes", "content")
    parsed = file_lines(contents).withColumn("record", F.from_json("line", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("line").isNotNull() & (F.col("record").isNull() | F.col("record._corrupt").isNotNull())
    parsed = parsed.withColumn("fault", F.coalesce("fault", F.when(bad, "no_record")))
    by = parsed.groupBy("digest", "file", "bytes").agg(F.count("line").alias("records"), F.min("fault").alias("reason"))
    records = parsed.where("line is not null").select("digest", "ordinal", "record.*").drop("_corrupt")
    return records, by


def import_files(spark: SparkSession, source: str, target: str, schema: str, confirm: bool = False) -> DataFrame:
    """Imports what is new below ``source`` into ``target`` and returns the ledger's rows of this run (``LEDGER``).

    Empty files hold nothing and are passed over. New are files whose content the ledger (``target/_ledger``) doesn't have, whatever their name. A file with any fault is
    quarantined whole: none of its records come in, and the ledger says why. Without ``confirm`` nothing is written. A
    file's records go to a partition of its own, ``digest=``, which a run after a failure overwrites alike; the ledger is
    written last, so that run takes up what the first did not finish. The folders must not overlap.
    """
    a, b = (p.rstrip("/") + "/" for p in (source, target))
    if a.startswith(b) or b.startswith(a):
        raise ValueError("source and target overlap: an import makes a table of its own and never writes to its source")
    records, files = scan(spark, source, schema)
    new = files.join(ledger(spark, target).select("digest"), "digest", "left_anti")
    state = F.when(F.col("reason").isNull(), "imported").otherwise("quarantined")
    new = new.withColumn("state", state if confirm else F.concat(F.lit("would_be_"), state)).select([x.split()[0] for x in LEDGER.split(", ")])
    if not confirm:
        return new
    new.write.mode("overwrite").parquet(f"{target}/_scan")  # a row per file, fixed before records are written
    rows = spark.read.schema(LEDGER).parquet(f"{target}/_scan")
    good = rows.where("state = 'imported' and records > 0").select("digest")
    records.join(good, "digest", "left_semi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("digest").parquet(f"{target}/records")
    rows.coalesce(1).write.mode("append").json(f"{target}/_ledger")
    return rows


def ledger(spark: SparkSession, target: str) -> DataFrame:
    from ..streaming.sinks import _exists

    return spark.read.schema(LEDGER).json(f"{target}/_ledger") if _exists(spark, f"{target}/_ledger") else spark.createDataFrame([], LEDGER)
