"""Window operators: runs, trailing windows, flat stretches, cooldown.

Rows that repeat count each; a null id sorts first, null keys are one key, and rows without a time come before all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def trailing(value: str, width: int) -> dict[str, Column]:
    """Over the key's known values in [t - width, t]: move (last - first), range and n; null with fewer than two values."""
    w = Window.partitionBy("key").orderBy("t").rangeBetween(-width, 0)
    v = F.col(value)
    order = F.when(v.isNotNull(), F.struct("t", "id"))
    n = F.count(v).over(w)
    last, first = F.max_by(v, order).over(w), F.min_by(v, order).over(w)
    return {"move": F.when(n >= 2, last - first), "range": F.when(n >= 2, F.max(v).over(w) - F.min(v).over(w)), "n": n}


def streak(rows: DataFrame, sign: str, most: int) -> DataFrame:
    """``streak``: how many rows in a run up to this one have its sign, at most ``most``; rows without sign break runs and have 0."""
    order = Window.partitionBy("key").orderBy("t", "id")
    breaks = F.coalesce(F.lag(sign).over(order) != F.col(sign), F.lit(True)) | (F.col(sign) == 0)
    islands = rows.withColumn("_break", breaks.cast("int")).withColumn("_island", F.sum("_break").over(order))
    place = F.row_number().over(Window.partitionBy("key", "_island").orderBy("t", "id"))
    return islands.withColumn("streak", F.when(F.col(sign) == 0, 0).otherwise(F.least(place, F.lit(most)))).drop("_break", "_island")


def flat_stretches(rows: DataFrame, value: str, width: int, band: int) -> DataFrame:
    """Rows from which on, in [t, t + width], every known value lies within ``band`` of the row's own, by two rows at least; ``end`` is t + width."""
    w, v = Window.partitionBy("key").orderBy("t").rangeBetween(0, width), F.col(value)
    flat = (F.count(v).over(w) >= 2) & (F.max(v).over(w) - v <= band) & (v - F.min(v).over(w) <= band)
    return rows.withColumn("_flat", flat).where("_flat").drop("_flat").withColumn("end", F.col("t") + width)


def equal_stretches(rows: DataFrame, value: str, width: int) -> DataFrame:
    """Rows from which on, in [t, t + width], every value is known and equal, by two rows at least; ``end`` is t + width."""
    w, v = Window.partitionBy("key").orderBy("t").rangeBetween(0, width), F.col(value)
    equal = (F.count("*").over(w) >= 2) & (F.count(v).over(w) == F.count("*").over(w)) & (F.max(v).over(w) == F.min(v).over(w))
    return rows.withColumn("_equal", equal).where("_equal").drop("_equal").withColumn("end", F.col("t") + width)


def within_wait(anchors: DataFrame, ticks: DataFrame, wait: int) -> DataFrame:
    """Pairs of an anchor (key, anchor, start, ...) and each tick (key, t, ...) in (start, start + wait].

    They meet by key and stretch of time, so a key's rows spread over tasks and only rows of two
    neighbouring stretches are held against each other.
    """
    part = F.floor(F.col("start") / wait)
    left = anchors.withColumn("_part", F.explode(F.array(part, part + 1)))
    right = ticks.withColumn("_part", F.floor(F.col("t") / wait))
    return left.join(right, ["key", "_part"]).where((F.col("t") > F.col("start")) & (F.col("t") <= F.col("start") + wait)).drop("_part")


def cooldown(rows: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """Rows that pass the cooldown of their keys, in order of (t, id).

    Whether a row passes hangs on the last one that passed, so rows are folded in order. A row that
    comes a whole cooldown after the one before it starts anew, so a key is dealt out by such bursts,
    and a hot key's rows spread over tasks; a task folds its sorted bursts as a stream.
    """
    by, wait = [*keys, "_burst"], int(seconds * 1_000_000)
    order = Window.partitionBy(*keys).orderBy("t", "id")
    fresh = F.coalesce(F.col("t") - F.lag("t").over(order) >= wait, F.lit(True))
    bursts = rows.withColumn("_burst", F.sum(fresh.cast("int")).over(order))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, None
        for rows in batches:
            passes = []
            for key, t in zip(zip(*(rows[k] for k in by), strict=True), rows["t"], strict=True):
                if key != at or t - last >= wait:
                    at, last = key, t
                    passes.append(True)
                else:
                    passes.append(False)
            yield rows[passes].drop(columns="_burst")

    dealt = bursts.repartition(*by).sortWithinPartitions(*by, "t", "id")
    return dealt.mapInPandas(fold, rows.schema)


def sessions(rows: DataFrame, gap: int) -> DataFrame:
    """Sessions per key, ended by a gap of more than ``gap`` microseconds: start, end, rows, first and last value."""
    order = Window.partitionBy("key").orderBy("t", "id")
    number = F.sum(F.coalesce((F.col("t") - F.lag("t").over(order) > gap).cast("int"), F.lit(0))).over(order)
    by = F.struct("t", "id")
    return rows.withColumn("session", number).groupBy("key", "session").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"), F.min_by("cents", by).alias("first_cents"), F.max_by("cents", by).alias("last_cents"))


def peak_rate(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The largest number of rows in any window of ``width`` microseconds that ends with a row.

    A key's time is cut into stretches of ``width``, each with the rows of the stretch before, so that a key
    with a fifth of all rows spreads over tasks. In a stretch, running counts at both ends of each
    row's window give its number without counting anew. Rows that repeat, or have no id, count each; rows
    without a time are in no window and not counted.
    """
    rows = rows.where("t is not null").withColumn("_row", F.monotonically_increasing_id())
    by = [*keys, "_part"]
    own = F.floor(F.col("t") / width)
    copies = rows.select(*keys, "t", F.explode(F.array(own, own + 1)).alias("_part"), F.lit(1).alias("_n"), F.lit(0).alias("_side"), F.lit(0).alias("_sign"))
    ends = F.explode(F.array(F.struct(F.col("t").alias("t"), F.lit(1).alias("sign")), F.struct((F.col("t") - width).alias("t"), F.lit(-1).alias("sign")))).alias("_e")
    probes = rows.select(*keys, own.alias("_part"), "_row", ends).select(*keys, "_part", "_row", F.col("_e.t").alias("t"), F.col("_e.sign").alias("_sign"), F.lit(0).alias("_n"), F.lit(1).alias("_side"))
    order = Window.partitionBy(*by).orderBy("t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = copies.unionByName(probes, allowMissingColumns=True).withColumn("_seen", F.sum("_n").over(order)).where("_side = 1")
    each = seen.groupBy(*by, "_row").agg(F.sum(F.col("_seen") * F.col("_sign")).alias("_rows"))
    return each.groupBy(*keys).agg(F.max("_rows").alias("peak"), F.count("*").alias("n"))
