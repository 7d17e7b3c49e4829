"""Retention: what goes by age, and what tiers keep."""

from __future__ import annotations

from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dry_run(rows: DataFrame, t: str, cutoff: Column, keys: list[str], protected: Column) -> DataFrame:
    """Per key: rows, those older than the cutoff, and of these the protected ones, which stay."""
    old = F.col(t) < cutoff
    count = lambda c: F.count(F.when(c, 1))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), count(old & ~protected).alias("would_delete"), count(old & protected).alias("kept_protected"), F.min(t).alias("oldest"))


def tiers(copies: DataFrame, at: str, id_: str, days: int, weeks: int, months: int) -> DataFrame:
    """The newest copy of each of the last days, ISO weeks and months that have any, with the tiers that keep it."""
    out = None
    for name, period, keep in (("day", F.date_trunc("day", at), days), ("week", F.date_trunc("week", at), weeks), ("month", F.date_trunc("month", at), months)):
        newest = copies.groupBy(period.alias("period")).agg(F.max_by(F.struct(F.col(id_), F.col(at)), F.struct(at, id_)).alias("x"))
        kept = newest.orderBy(F.desc("period")).limit(keep).select("x.*", F.lit(name).alias("tier"))
        out = kept if out is None else out.unionByName(kept)
    return out.groupBy(id_).agg(F.array_join(F.array_sort(F.collect_set("tier")), ",").alias("tiers"))


def newest_bytes(rows: DataFrame, column: str, order: list[Column], n: int) -> DataFrame:
    """Stored bytes of a column over the newest n rows; the JSON text null counts as missing."""
    size = F.octet_length(F.when(F.col(column) != "null", F.col(column)))
    return rows.orderBy(*order).limit(n).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("n"))


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; the limit is applied before the shuffle as well as after it."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


@dataclass(frozen=True)
class Policy:
    """When a table's row is due to go, what protects it, and the rows of another table that it belongs to."""

    due: Column
    protected: Column
    parent: str | None = None
    key: str | None = None  #: the column that names the parent's row, by its column ``parent_key``
    parent_key: str | None = None


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def cascade(tables: dict[str, DataFrame], policies: dict[str, Policy]) -> dict[str, DataFrame]:
    """Each table with ``fate``, children before parents: deleted, cascaded (its parent goes), kept_protected, kept_for_child or kept.

    A row goes if it is due, or if its parent goes; but never a protected one, nor one with a row below it, at any depth, that is
    protected. So no row is left without its parent. One join per edge up and one down, by keys alone; missing keys have no parent.
    """
    order = list(TopologicalSorter({n: {p.parent} - {None} for n, p in policies.items()}).static_order())  # parents first
    marked = {n: df.withColumn("_held", _flag(policies[n].protected)).withColumn("_child", F.lit(False)) for n, df in tables.items()}
    for name in reversed(order):
        p = policies[name]
        if p.parent:
            held = marked[name].where(F.col("_held") | F.col("_child")).select(F.col(p.key).alias("_k")).where("_k is not null").distinct().withColumn("_below", F.lit(True))
            up = marked[p.parent]
            marked[p.parent] = up.join(held, up[p.parent_key] == F.col("_k"), "left").withColumn("_child", F.col("_child") | _flag(F.col("_below"))).drop("_k", "_below")
    out: dict[str, DataFrame] = {}
    for name in order:
        p, rows = policies[name], marked[name].withColumn("_gone", F.lit(False))
        if p.parent:
            gone = out[p.parent].where(F.col("fate").isin("deleted", "cascaded")).select(F.col(p.parent_key).alias("_k")).where("_k is not null").distinct().withColumn("_above", F.lit(True))
            rows = rows.join(gone, rows[p.key] == F.col("_k"), "left").withColumn("_gone", _flag(F.col("_above"))).drop("_k", "_above")
        free = ~F.col("_held") & ~F.col("_child")
        fate = F.when(free & _flag(p.due), "deleted").when(free & F.col("_gone"), "cascaded").when(F.col("_held") & (_flag(p.due)), "kept_protected").when(F.col("_child") & _flag(p.due), "kept_for_child").otherwise("kept")
        out[name] = rows.withColumn("fate", fate).drop("_held", "_child", "_gone")
    return {n: out[n] for n in reversed(order)}


def plan(fates: dict[str, DataFrame]) -> DataFrame:
    """(table, n, and how many of each fate): what ``prune`` would do."""
    counts = [df.groupBy().agg(F.count("*").alias("n"), *[F.count(F.when(F.col("fate") == f, 1)).alias(f) for f in ("deleted", "cascaded", "kept_protected", "kept_for_child", "kept")]).select(F.lit(n).alias("table"), "*") for n, df in fates.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
