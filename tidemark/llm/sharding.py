"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A shard's rows are numbered in this many parts, so that no task sees a whole shard.
SLOT_PARTS = 1024


def uniform(key: Column, salt: Column) -> Column:
    """A number in (0, 1) that the key and the salt decide: 60 bits of their MD5, which any engine has."""
    digits = F.substring(F.md5(F.concat_ws(":", key.cast("string"), salt.cast("string"))), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**15))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose score -weight / ln(u(key, shard)) is largest; ties go to the smaller shard.

    A shard's chance is its weight's share. A shard that is added scores apart from the others,
    so rows move only to it; one that goes gives up only its own rows.
    """
    scores = [F.struct((F.lit(float(w)) / -F.log(uniform(key, F.lit(i)))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]
    return (-F.greatest(*scores)["shard"]).cast("int")


def assign_shards(docs: DataFrame, shards: int = 16, weights: Sequence[float] | None = None, grown_weight: float = 1.0, slot_parts: int = SLOT_PARTS) -> DataFrame:
    """Puts every row of ``docs`` (doc_id, text) into one of ``shards`` shards by its doc_id alone.

    Returns doc_id, size (UTF-8 bytes of the text, null none, plus 1), text_crc32, law ('key'),
    shard, slot (gapless from 0 within the shard) and grown_shard (the shard with one more).
    Slots come from two levels: rows are counted by (shard, part of the doc_id's hash), a table of
    at most ``shards * slot_parts`` rows gets running sums and, being bounded by its parameters,
    is broadcast; rows are then numbered within their part. No row travels further than to its part.

    A null doc_id is a key of its own; a null text counts as empty; repeated rows share a shard
    and take neighbouring slots; an empty table gives no rows; further columns are ignored.
    """
    weights = [1.0] * shards if weights is None else list(weights)
    if len(weights) != shards or any(not w > 0 or math.isinf(w) for w in weights):
        raise ValueError("weights: one finite positive number per shard")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, grown_weight]).alias("grown_shard"),
        F.pmod(F.crc32(F.encode(F.concat_ws(":", key, F.lit("slot")), "UTF-8")), F.lit(slot_parts)).cast("int").alias("part"),
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("rank", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("before") + F.col("rank")).cast(T.LongType()).alias("slot"), "grown_shard"
    )
