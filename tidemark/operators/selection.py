"""Selections from long ranked lists: a queue that rotates, and picks spread over events with gates on what was picked."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def queue_places(rows: DataFrame, tier: str, t: str, tie: str, width: int) -> DataFrame:
    """``rows`` with ``place``, from 0, in order of (tier, t, tie); missing tiers and times come last.

    Only counts by tier and stretch of ``width`` are ordered in one place; each stretch is ranked by its own task. Rows alike in all three
    stand in any order.
    """
    rows = rows.withColumn("_stretch", F.floor(F.col(t) / width))
    order = [F.asc_nulls_last(tier), F.asc_nulls_last("_stretch")]
    counts = rows.groupBy(tier, "_stretch").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(tier).alias("_tier"), F.col("_stretch").alias("_at"), before.alias("_before"))
    within = F.row_number().over(Window.partitionBy(tier, "_stretch").orderBy(F.asc_nulls_last(t), tie))
    ranked = rows.withColumn("_within", within)
    met = ranked.join(offsets, F.col(tier).eqNullSafe(F.col("_tier")) & F.col("_stretch").eqNullSafe(F.col("_at")))
    return met.withColumn("place", F.col("_before") + F.col("_within") - 1).drop("_stretch", "_within", "_tier", "_at", "_before")


def rotation(placed: DataFrame, limit: int, cycle: Column) -> DataFrame:
    """The ``limit`` rows of a placed queue whose turn it is in round ``cycle``, with ``turn`` from 0: the queue is read on from where the round before ended, around its end.

    While the queue stays as it is, each row comes up within ceil(n / limit) rounds, so a head that always fails can't keep
    the others out. A limit of n or more takes all. An empty queue gives no rows.
    """
    size = placed.agg(F.count("*").alias("_size"))
    turn = F.pmod(F.col("place") - F.pmod(cycle * limit, F.greatest("_size", F.lit(1))), F.greatest("_size", F.lit(1)))
    return placed.join(F.broadcast(size)).withColumn("turn", turn).where(F.col("turn") < limit).drop("_size")


def spread_picks(ranked: DataFrame, count: int, strata: list[str]) -> DataFrame:
    """``count`` rows of each stratum (stratum, event, place, ...), in order of strata: first those of events that no pick has, then the next by place.

    Whether a row is picked hangs on the picks before it, so a list is folded in order; but only rows that can be
    picked come to the fold: of each stratum the first of each event, as many as all strata together pick, and the first rows by
    place: never more than ``count`` times a square of the number of strata. Rows without an event are an event each.
    """
    rows = ranked.withColumn("_event", F.coalesce(F.col("event").cast("string"), F.concat(F.lit("row "), F.col("place").cast("string"))))
    first = F.row_number().over(Window.partitionBy("stratum", "_event").orderBy("place"))
    rows = rows.withColumn("_first", first).where(F.col("_first") <= count)
    heads = rows.where("_first = 1").withColumn("_n", F.row_number().over(Window.partitionBy("stratum").orderBy("place"))).where(F.col("_n") <= count * len(strata))
    top = rows.withColumn("_n", F.row_number().over(Window.partitionBy("stratum").orderBy("place"))).where(F.col("_n") <= 2 * count)
    cut = heads.unionByName(top).drop("_n", "_first").dropDuplicates(["stratum", "place"])

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        used, picked = set(), []
        for stratum in strata:
            own = group[group["stratum"] == stratum].sort_values("place")
            chosen: list[int] = []
            for i, event in zip(own.index, own["_event"], strict=True):
                if len(chosen) < count and event not in used:
                    chosen.append(i)
                    used.add(event)
            chosen += [i for i in own.index if i not in chosen][: count - len(chosen)]
            picked += chosen
        return group.loc[picked].drop(columns=["_event", "_all"])

    return cut.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fold, ranked.schema)


def gate_failures(picked: DataFrame, count: int, strata: list[str], least_ratio: float, least_events: int, least_series: int, most_of_event: int) -> DataFrame:
    """One row, ``failures``: what keeps a selection (stratum, event, series, value) from qualifying; empty if it does.

    Strata must be full, and apart: the least value of one over the largest of the next at least ``least_ratio``, as cuts through a
    ranking are always in order; events and series must be several, and none the source of most.
    """
    low, high = ({s: F.min(F.when(F.col("stratum") == s, F.col("value"))) if f == "min" else F.max(F.when(F.col("stratum") == s, F.col("value"))) for s in strata} for f in ("min", "max"))
    sizes = {s: F.count(F.when(F.col("stratum") == s, 1)) for s in strata}
    facts = picked.agg(*[x.alias(f"{n}_{s}") for n, of in (("low", low), ("high", high), ("n", sizes)) for s, x in of.items()], F.count_distinct("event").alias("events"), F.count_distinct("series").alias("series"))
    largest = picked.where("event is not null").groupBy("event").agg(F.count("*").alias("k")).agg(F.coalesce(F.max("k"), F.lit(0)).alias("largest"))
    reasons = [(F.col(f"n_{s}") != count, f"stratum_{s}_not_full") for s in strata]
    for a, b in zip(strata, strata[1:], strict=False):
        over, under = F.col(f"low_{a}"), F.col(f"high_{b}")
        apart = F.when(over == under, "tied").when(~(under > 0), "undefined").when(over / under < least_ratio, "too_close")
        reasons.append((apart.isNotNull(), F.concat(F.lit(f"{a}_over_{b}_"), apart)))
    reasons += [(F.col("events") < least_events, "few_events"), (F.col("series") < least_series, "few_series"), (F.col("largest") > most_of_event, "one_event_dominates")]
    named = F.array(*[F.when(F.coalesce(c, F.lit(False)), n if isinstance(n, Column) else F.lit(n)) for c, n in reasons])
    return facts.join(F.broadcast(largest)).select(F.filter(named, lambda x: x.isNotNull()).alias("failures"))
