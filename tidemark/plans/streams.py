"""Batch forms of what streams do: bars merged from parts, and ledgers that forget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats, text
from ..operators import dedupe
from ..streaming import sinks
from .registry import TICKS, query, table, ticks


@query(f"""WITH {TICKS} SELECT key, t - t % 3600000000 AS bucket, arg_min(cents, (t, id)) AS open, max(cents) AS high, min(cents) AS low, arg_max(cents, (t, id)) AS close, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n FROM ticks WHERE cents IS NOT NULL GROUP BY 1, 2""")
def reaggregated_bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of three deliveries of ticks, merged as ``sinks.commit_batch`` merges batches; the same bars as from all ticks at once."""
    rows = ticks(spark, d)
    parts = [sinks.bars(rows.where(F.col("id") % 3 == i), 3600) for i in range(3)]
    return sinks.merged(reduce(DataFrame.unionByName, parts)).drop("first_t", "first_id", "last_t", "last_id")


_KEEP = 40


@query(f"""WITH a AS (SELECT doc_id AS id, source || ':' || (doc_id // 3)::VARCHAR AS delivery, lang || ':' || (doc_id // 2)::VARCHAR AS message, sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))) AS content FROM documents),
k AS (SELECT unnest([{{'kind': 'delivery', 'key': delivery}}, {{'kind': 'message', 'key': message}}, {{'kind': 'content', 'key': content}}]) AS x, id FROM a),
g AS (SELECT x.kind AS kind, x.key AS key, id, id - lag(id) OVER (PARTITION BY x ORDER BY id) AS since, (SELECT max(doc_id) FROM documents) - id AS left_over, lead(id) OVER (PARTITION BY x ORDER BY id) IS NULL AS last FROM k WHERE x.key IS NOT NULL)
SELECT kind, count(DISTINCT key) AS keys, CAST(count(*) FILTER (WHERE since < {_KEEP}) AS BIGINT) AS seen, CAST(count(*) FILTER (WHERE since >= {_KEEP}) + count(*) FILTER (WHERE last AND left_over >= {_KEEP}) AS BIGINT) AS evicted FROM g GROUP BY 1""")
def ledger_evictions(spark: SparkSession, d: str) -> DataFrame:
    """Per ledger of a bounded memory, the keys, the artifacts that found theirs, and how often a key was forgotten, so that fewer hits can be told from a shorter memory."""
    half = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("t"), F.concat(F.col("source"), F.lit(":"), half(3)).alias("delivery"), F.concat(F.col("lang"), F.lit(":"), half(2)).alias("message"), text.content_identity(F.col("text")).alias("content"))
    each = dedupe.ledger_rows(rows).where("key like '=%'")
    order = Window.partitionBy("kind", "key").orderBy("t", "id")
    since, last = F.col("t") - F.lag("t").over(order), F.lead("t").over(order).isNull()
    latest = rows.agg(F.max("t").alias("latest"))
    marked = each.withColumn("since", since).withColumn("last", last).join(F.broadcast(latest))
    gone = F.col("last") & (F.col("latest") - F.col("t") >= _KEEP)
    return marked.groupBy("kind").agg(F.count(F.when(F.col("last"), 1)).alias("keys"), stats.count_where(F.col("since") < _KEEP).alias("seen"), (stats.count_where(F.col("since") >= _KEEP) + stats.count_where(gone)).alias("evicted"))
