"""Ranks and percentiles from counts, so that no group is held whole and no ranking is one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _with_offsets(rows: DataFrame, keys: list[str], bucket: Column, n: Column, ascending: bool = True) -> DataFrame:
    """``rows`` with ``_bucket``, and in ``_before`` the sum of ``n`` in the buckets of their keys that come before it.

    Only one count per bucket is ordered in one place, and buckets are bounded by the range of the values.
    """
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.sum(n).alias("_n"))
    order = F.asc_nulls_last("_bucket") if ascending else F.desc_nulls_last("_bucket")
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(offsets, same).drop("_b", *[f"_k{i}" for i in range(len(keys))])


def placed(rows: DataFrame, value: str, tie: str, width: float) -> DataFrame:
    """``place``: 1 for the largest value, ties by ``tie``; rows are ranked within stretches of ``width``, and stretches by their counts."""
    found = _with_offsets(rows, [], F.floor(F.col(value) / width), F.lit(1), ascending=False)
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.desc_nulls_last(value), tie))
    return found.withColumn("place", F.col("_before") + within).drop("_before", "_bucket")


def value_counts(rows: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """Per key and value: ``n``, and ``upto``, the rows of the key with this value or a smaller one; nulls come last."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    found = _with_offsets(counts, keys, F.floor(F.col(value) / width), F.col("n"))
    within = F.sum("n").over(Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("upto", F.col("_before") + within).drop("_before", "_bucket")


def rounded_rank(known: Column, p: float) -> Column:
    """The rank round(p * (n - 1)) from 0, half ranks to even, as one from 1; no interpolation."""
    return F.bround(F.lit(p) * (known - 1)) + 1


def nearest_rank(known: Column, p: float, floor: int) -> Column:
    """The rank ceil(p * n); null with fewer than ``floor`` values."""
    return F.when(known >= floor, F.ceil(F.lit(p) * known))


def at_ranks(counts: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], also: dict[str, Column] | None = None) -> DataFrame:
    """Per key ``n`` (all rows), ``known`` (rows with a value), by name the value at each rank, and what else is asked.

    Ranks start at 1 and are expressions over ``known``; a null rank gives null.
    """
    known = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col(value).isNotNull(), F.col("n"))), F.lit(0)).alias("known"), *[c.alias(k) for k, c in (also or {}).items()])
    sizes = known.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "known", *[r.alias(f"_r_{name}") for name, r in ranks.items()]).drop("known")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # values ascend with upto, so the value at a rank is the smallest one that reaches it
    met = counts.join(sizes, same).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*[F.min(F.when(F.col("upto") >= F.col(f"_r_{name}"), F.col(value))).alias(name) for name in ranks])
    return known.join(met, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
