"""Segments: how a writer cuts them, how they are sealed, and what a check against their manifests finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import chains
from .registry import TICKS, query, table, ticks

_MOST_RECORDS, _MOST_BYTES, _MOST_AGE = 8, 60, 3 * 24 * 3_600_000_000


@query(f"""WITH RECURSIVE {TICKS}, r AS (SELECT key, id, t, length(concat(type, ':', cents)) AS size, row_number() OVER (PARTITION BY key ORDER BY t, id) AS turn FROM ticks),
c AS (SELECT key, id, t, turn, 0 AS no, 0 AS place, t AS opened, size AS total FROM r WHERE turn = 1
UNION ALL SELECT r.key, r.id, r.t, r.turn, CASE WHEN cut THEN no + 1 ELSE no END, CASE WHEN cut THEN 0 ELSE place + 1 END, CASE WHEN cut THEN r.t ELSE opened END, CASE WHEN cut THEN r.size ELSE total + r.size END
FROM (SELECT c.*, n.t AS next_t, (place + 1 >= {_MOST_RECORDS} OR total >= {_MOST_BYTES} OR n.t - opened >= {_MOST_AGE}) AS cut FROM c JOIN r n ON n.key = c.key AND n.turn = c.turn + 1) p JOIN r ON r.key = p.key AND r.turn = p.turn + 1)
SELECT key, id, CAST(no AS BIGINT) AS segment_no, CAST(place AS BIGINT) AS place FROM c""")
def segment_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Where a writer that rotates by records, bytes and age ends its segments."""
    rows = ticks(spark, d)
    size = F.octet_length(F.concat_ws(":", "type", F.col("cents").cast("string")))
    return chains.rotated(rows, "key", ["t", "id"], "t", size, _MOST_RECORDS, _MOST_BYTES, _MOST_AGE).select("key", "id", "segment_no", "place")


def conversation_records(spark: SparkSession, d: str) -> DataFrame:
    """Turns as sealed records: segment (the conversation), ordinal, content, prev, digest."""
    turns = table(spark, d, "conversations")
    ordinal = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return chains.sealed(turns.select(F.col("conv_id").alias("segment"), ordinal.cast("long").alias("ordinal"), F.concat_ws(":", "role", "text").alias("content")))


def tampered(records: DataFrame) -> DataFrame:
    """Records as someone might leave them, by the segment's number in a cycle of 9: a changed text, a record dropped from the middle or the end, two swapped, a chain begun anew, a record twice, segments gone."""
    n, ordinal, last = F.col("segment") % 9, F.col("ordinal"), F.max("ordinal").over(Window.partitionBy("segment"))
    rows = records.withColumn("_last", last).where(~(((n == 2) & (ordinal == 1)) | ((n == 3) & (ordinal == F.col("_last"))) | (n == 8))).drop("_last")
    rows = rows.withColumn("content", F.when((n == 1) & (ordinal == 1), F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    rows = rows.withColumn("ordinal", F.when((n == 4) & (ordinal < 2), 1 - ordinal).otherwise(ordinal))
    rows = rows.withColumn("prev", F.when((n == 5) & (ordinal == 0), "x").otherwise(F.col("prev")))
    rows = rows.withColumn("digest", F.when((n == 5) & (ordinal == 0), chains.record_digest(F.col("segment"), ordinal, F.col("prev"), F.col("content"))).otherwise(F.col("digest")))
    return rows.withColumn("_copy", F.explode(F.when((n == 6) & (ordinal == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copy")


_SEAL = """r AS (SELECT conv_id AS segment, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS ordinal, '+' || concat_ws(':', role, text) AS content FROM conversations),
c AS (SELECT segment, ordinal, content, sha256('genesis' || chr(10) || segment) AS prev, sha256(concat_ws(chr(10), segment, ordinal, sha256('genesis' || chr(10) || segment), content)) AS digest FROM r WHERE ordinal = 0
UNION ALL SELECT r.segment, r.ordinal, r.content, c.digest, sha256(concat_ws(chr(10), r.segment, r.ordinal, c.digest, r.content)) FROM c JOIN r ON r.segment = c.segment AND r.ordinal = c.ordinal + 1)"""
_ROOT = "sha256(sha256(sha256(string_agg(digest, ':' ORDER BY ordinal, digest))))"  # three levels, one node each


@query(f"""WITH RECURSIVE {_SEAL}, m AS (SELECT segment, count(*) AS was, {_ROOT} AS root FROM c GROUP BY 1),
l AS (SELECT *, max(ordinal) OVER (PARTITION BY segment) AS last FROM c),
a AS (SELECT segment, CASE WHEN segment % 9 = 4 AND ordinal < 2 THEN 1 - ordinal ELSE ordinal END AS ordinal, CASE WHEN segment % 9 = 1 AND ordinal = 1 THEN content || '!' ELSE content END AS content, CASE WHEN segment % 9 = 5 AND ordinal = 0 THEN 'x' ELSE prev END AS prev,
 CASE WHEN segment % 9 = 5 AND ordinal = 0 THEN sha256(concat_ws(chr(10), segment, ordinal, 'x', content)) ELSE digest END AS digest, unnest(CASE WHEN segment % 9 = 6 AND ordinal = 0 THEN [0, 1] ELSE [0] END) AS copy
 FROM l WHERE NOT ((segment % 9 = 2 AND ordinal = 1) OR (segment % 9 = 3 AND ordinal = last) OR segment % 9 = 8)),
b AS (SELECT segment, ordinal, count(*) AS same, min(digest) AS digest FROM a GROUP BY 1, 2),
f AS (SELECT a.segment, a.ordinal, a.digest, CASE WHEN a.digest <> sha256(concat_ws(chr(10), a.segment, a.ordinal, a.prev, a.content)) THEN 'content_changed' WHEN o.same > 1 THEN 'ordinal_repeated' WHEN a.ordinal = 0 THEN CASE WHEN a.prev <> sha256('genesis' || chr(10) || a.segment) THEN 'wrong_genesis' END
 WHEN p.digest IS NULL THEN 'predecessor_missing' WHEN a.prev <> p.digest THEN 'link_broken' END AS fault FROM a JOIN b o ON o.segment = a.segment AND o.ordinal = a.ordinal LEFT JOIN b p ON p.segment = a.segment AND p.ordinal = a.ordinal - 1),
g AS (SELECT segment, count(*) AS records, min(ordinal) FILTER (WHERE fault IS NOT NULL) AS first_fault, arg_min(fault, (ordinal, fault)) FILTER (WHERE fault IS NOT NULL) AS fault, {_ROOT} AS root FROM f GROUP BY 1)
SELECT segment, coalesce(records, 0) AS records, first_fault, CASE WHEN records IS NULL THEN 'segment_missing' WHEN fault IS NOT NULL THEN fault WHEN records <> was THEN 'count_differs' WHEN g.root <> m.root THEN 'root_differs' ELSE 'ok' END AS verdict FROM m LEFT JOIN g USING (segment)""")
def segment_verification(spark: SparkSession, d: str) -> DataFrame:
    """Tampered records against the manifests of the sealed ones; digests are made anew from content."""
    records = conversation_records(spark, d)
    return chains.verified(tampered(records), chains.manifests(records))


@query(f"""WITH RECURSIVE {_SEAL}, m AS (SELECT segment, {_ROOT} AS root FROM c GROUP BY 1),
x AS (SELECT segment, segment % 5 AS archive, segment // 5 AS place, root FROM m), k AS (SELECT archive, place // 1024 AS run, sha256(string_agg(root, ':' ORDER BY place, root)) AS node FROM x GROUP BY 1, 2)
SELECT archive, segments, sha256(sha256(string_agg(node, ':' ORDER BY run))) AS head FROM k JOIN (SELECT archive, count(*) AS segments FROM x GROUP BY 1) USING (archive) GROUP BY 1, 2""")
def archive_heads(spark: SparkSession, d: str) -> DataFrame:
    """One digest per archive over its segments in order."""
    committed = chains.manifests(conversation_records(spark, d)).withColumn("archive", F.col("segment") % 5).withColumn("place", F.floor(F.col("segment") / 5))
    return chains.heads(committed, "archive", "place")
