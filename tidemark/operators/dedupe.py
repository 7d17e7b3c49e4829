"""Verdicts on deliveries of messages, and purity of delivery modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: What is remembered of artifacts: a ledger per kind of key.
LEDGERS = ("delivery", "message", "content")


def verdict(again: Column, known: Column, was: Column, content: Column, spread: Column) -> Column:
    """The ladder: a delivery seen before, a message known with other or the same content, content known from elsewhere, or new."""
    return (
        F.when(again, "redelivery").when(known & ~was.eqNullSafe(content), "revision")
        .when(known, "restream").when(spread, "propagation").otherwise("novel")
    )


def verdicts(artifacts: DataFrame, retention: int | None = None) -> DataFrame:
    """redelivery, revision, restream, propagation or novel for each artifact (delivery, message, content, t, id), in order of (t, id).

    A delivery seen before is a redelivery. A message seen before is a revision if its content
    changed since, else a restream. Content seen before from another message is a propagation.
    Three windows, each by its own key. With ``retention`` a key is forgotten when so long after its last
    artifact, as a ledger of bounded size does. A missing key has never been seen; rows that repeat count each.
    """
    rows = artifacts
    for name in LEDGERS:
        order = Window.partitionBy(name).orderBy("t", "id")
        since = F.col("t") - F.lag("t").over(order)
        seen = F.col(name).isNotNull() & since.isNotNull() & (F.lit(True) if retention is None else since < retention)
        rows = rows.withColumn(f"_{name}", seen)
        if name == "message":
            rows = rows.withColumn("_was", F.lag("content").over(order))
    out = rows.withColumn("verdict", verdict(F.col("_delivery"), F.col("_message"), F.col("_was"), F.col("content"), F.col("_content")))
    return out.drop("_was", *[f"_{n}" for n in LEDGERS])


def ledger_rows(artifacts: DataFrame) -> DataFrame:
    """A row per artifact and ledger (kind, key, value, id, t, content and what else it has); a missing key stands alone."""
    alone = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.concat(F.lit("?"), F.col("id").cast("string")))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), alone(n).alias("key")) for n in LEDGERS])).alias("_k")
    return artifacts.select("*", each).select("_k.kind", "_k.key", "id", "t", "content", *[c for c in artifacts.columns if c not in ("id", "t", "content", *LEDGERS)])


def from_ledgers(evidence: DataFrame) -> DataFrame:
    """(id, verdict) of the rows (id, kind, seen, was, content) that ledgers gave; all of an artifact's are in ``evidence``."""
    of = lambda name, c: F.max(F.when(F.col("kind") == name, F.col(c)))
    by = evidence.where("id is not null").groupBy("id").agg(*[of(n, "seen").alias(n) for n in LEDGERS], of("message", "was").alias("was"), F.max("content").alias("text"))
    return by.select("id", verdict(F.col("delivery"), F.col("message"), F.col("was"), F.col("text"), F.col("content")).alias("verdict"))


# How an artifact came to us, and what its cohort may be used for.
MODES = ("LIVE", "BACKFILL", "PULLED", "UNKNOWN")
TIMING = "LATENCY_LEAD_LAG"


def cohort(rows: DataFrame, mode: str, column: str = "mode") -> DataFrame:
    """``rows`` as the cohort of one mode. It filters nothing: a row of another mode, or of none, fails the job that reads it."""
    return rows.where(F.assert_true(F.coalesce(F.col(column) == mode, F.lit(False)), f"a cohort of {mode} was given rows of another mode or of none").isNull())


def by_mode(rows: DataFrame, column: str = "mode") -> dict[str, DataFrame]:
    """The rows of each mode; a row whose mode is missing or not among MODES fails whichever of them is read."""
    known = F.when(F.coalesce(F.col(column).isin(*MODES), F.lit(False)), F.col(column)).otherwise(F.raise_error(F.lit("a row has no known mode")))
    return {mode: rows.where(known == mode) for mode in MODES}  # the check is part of the condition, so none can come before it


def permits(mode: str, purpose: str) -> bool:
    """Whether a cohort of ``mode`` may be used for ``purpose``: only live rows tell when something could be known."""
    return mode == MODES[0] or purpose != TIMING
