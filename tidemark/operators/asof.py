"""As-of lookups in four modes, with one rule for ties: the row id decides.

Anchors and ticks are laid in one stream per key and the last or next tick is carried over, so a
key's rows are sorted once and no pair is ever made.

Rows that repeat come out as often as they go in, with a null id or key too (null keys are one key). A null
id ranks below all others; rows without a time find nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import partitions

MINUTE = 60_000_000


def last_within(rows: DataFrame, values: list[str], widths: dict[str, int], key: str = "key", t: str = "t", tie: str = "id", size: int | None = None) -> DataFrame:
    """``rows`` with a struct of ``values`` per name of ``widths``: of the last row in (t, t + width], null if there is none.

    Each row's deadlines are laid in the key's stream behind the rows of their time, and the last row is
    carried over: one shuffle by key and one sort, whatever the number of rows within a width. Its deadlines
    find back to a row by a number of its own, so rows that are alike stay apart. Partitions follow
    ``size``, the number of rows (counted if not given), so a task's sort stays as large as it is.
    """
    first = next(iter(widths))
    parts = partitions(rows.sparkSession, (rows.count() if size is None else size) * (1 + len(widths)))
    rows = rows.select("*", F.monotonically_increasing_id().alias("_n"))
    columns = rows.columns[:-1]
    ticks = rows.select(key, F.col(t).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.struct(F.col(t).alias("t"), F.struct(*values).alias("v")).alias("_tick"))
    ends = rows.select(key, F.col(t).alias("_t"), "_n", F.struct(*columns).alias("_row"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("width")) for n, w in widths.items()])).alias("_w"))
    ends = ends.select(key, (F.col("_t") + F.col("_w.width")).alias("_at"), F.lit(1).alias("_side"), "_n", "_t", F.col("_w.name").alias("_name"), F.when(F.col("_w.name") == first, F.col("_row")).alias("_row"))
    order = Window.partitionBy(key).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    stream = ticks.unionByName(ends, allowMissingColumns=True).repartition(parts, key)
    found = stream.withColumn("_last", F.last("_tick", ignorenulls=True).over(order)).where("_side = 1")
    last = F.when(F.col("_last.t") > F.col("_t"), F.col("_last.v"))
    out = found.groupBy(key, "_n").agg(F.any_value("_row", True).alias("_row"), *[F.any_value(F.when(F.col("_name") == n, last), True).alias(n) for n in widths])
    return out.select("_row.*", *widths)


def carried(probes: DataFrame, at: str, ticks: DataFrame, values: list[str | Column], name: str, ahead: bool = False, key: str = "key", t: str = "t", tie: str = "id") -> DataFrame:
    """``probes`` with the last tick at or before time ``at`` (``ahead``: the first one at or after it) as a struct ``name`` of t and ``values``.

    Of ticks of one time the highest id counts, ahead the lowest. Probes without a time get null.
    """
    side = 0 if not ahead else 1
    a = probes.select(key, F.col(at).alias("_at"), F.lit(1 - side).alias("_side"), F.struct(*probes.columns).alias("_probe"))
    b = ticks.select(key, F.col(t).alias("_at"), F.lit(side).alias("_side"), F.col(tie).alias("_tie"), F.struct(F.col(t).alias("t"), *values).alias("_tick"))
    # looking ahead is looking back in falling order: a frame to the end of a key would be read anew for each row
    order = [F.desc(c) if ahead else F.asc(c) for c in ("_at", "_side", "_tie")]
    found = F.last("_tick", ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return a.unionByName(b, allowMissingColumns=True).withColumn("_found", found).where("_probe is not null").select("_probe.*", F.when(F.col("_at").isNotNull(), F.col("_found")).alias(name))


def first_in_lookback(rows: DataFrame, value: str, name: str, width: int, key: str = "key", t: str = "t", tie: str = "id") -> DataFrame:
    """``rows`` with the value, as ``name``, of the first row in [t - width, t]; among rows of one time the lowest id.

    That is the first row at or after t - width, the row's own time at the latest.
    """
    found = carried(rows.withColumn("_from", F.col(t) - width), "_from", rows, [F.col(value).alias("value")], "_first", ahead=True, key=key, t=t, tie=tie)
    return found.select(*rows.columns, F.col("_first.value").alias(name))


def _stream(anchors: DataFrame, ticks: DataFrame, key: str, t: str, tie: str, value: str, first: int) -> DataFrame:
    """Both sides as one table; ``first`` is the rank of ticks among rows of one time (anchors: 1)."""
    a = anchors.select(key, t, F.lit(1).alias("_side"), F.col(tie).alias("_id"), F.lit(None).cast(ticks.schema[value].dataType).alias("_value"), F.struct(*anchors.columns).alias("_anchor"))
    b = ticks.select(key, t, F.lit(first).alias("_side"), F.col(tie).alias("_id"), F.col(value).alias("_value"), F.lit(None).cast(a.schema["_anchor"].dataType).alias("_anchor"))
    return a.unionByName(b).withColumn("_tick", F.when(F.col("_anchor").isNull(), F.struct(F.col(t).alias("t"), F.col("_id").alias("id"), F.col("_value").alias("value"))))


def asof_backward(anchors: DataFrame, ticks: DataFrame, key: str, t: str, tie: str, value: str, max_age: int) -> DataFrame:
    """Anchors with the last tick at or before them: asof_value and asof_age, null beyond ``max_age``; ties go to the highest id."""
    order = Window.partitionBy(key).orderBy(t, "_side", "_id").rowsBetween(Window.unboundedPreceding, 0)
    found = _stream(anchors, ticks, key, t, tie, value, 0).withColumn("_last", F.last("_tick", ignorenulls=True).over(order)).where("_anchor is not null")
    age = F.col(t) - F.col("_last.t")
    return found.select("_anchor.*", F.when(age <= max_age, F.col("_last.value")).alias("asof_value"), F.when(age <= max_age, age).alias("asof_age"))


def asof_bracket(anchors: DataFrame, ticks: DataFrame, key: str, t: str, tie: str, value: str, shift: int) -> DataFrame:
    """Anchors with the last tick at or before t + shift and the first one after it, as structs ``before`` and ``after`` (t, id, value).

    Among ticks of one time the first id is taken on the side before, and on the side after.
    """
    ticks = ticks.groupBy(key, t).agg(F.min_by(value, tie).alias(value), F.min(tie).alias(tie))
    target = anchors.withColumn("_at", F.col(t)).withColumn(t, F.col(t) + shift)
    stream = _stream(target, ticks, key, t, tie, value, 0)
    back, ahead = (Window.partitionBy(key).orderBy(*[o(c) for c in (t, "_side", "_id")]).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc, F.desc))
    found = stream.withColumn("before", F.last("_tick", ignorenulls=True).over(back)).withColumn("after", F.last("_tick", ignorenulls=True).over(ahead))
    found = found.where("_anchor is not null").select("_anchor.*", F.col(t).alias("target"), "before", "after")
    return found.withColumn(t, F.col("_at")).drop("_at")


def nearest(anchors: DataFrame, ticks: DataFrame, key: str, t: str, tie: str, value: str, shift: int, tolerance: int) -> DataFrame:
    """The tick nearest to t + shift within the tolerance: near_value and near_distance; of two as near the earlier one."""
    found = asof_bracket(anchors, ticks, key, t, tie, value, shift)
    left, right = F.col("target") - F.col("before.t"), F.col("after.t") - F.col("target")
    use_left = left.isNotNull() & (right.isNull() | (left <= right))
    distance = F.when(use_left, left).otherwise(right)
    near = F.when(use_left, F.col("before.value")).otherwise(F.col("after.value"))
    within = distance <= tolerance
    return found.select(*anchors.columns, F.when(within, near).alias("near_value"), F.when(within, distance).alias("near_distance"))


def interpolated(anchors: DataFrame, ticks: DataFrame, key: str, t: str, tie: str, value: str, shift: int, max_gap: int) -> DataFrame:
    """The value at t + shift on the line between the ticks around it, where they are at most ``max_gap`` apart; how it was had is in ``source``."""
    found = asof_bracket(anchors, ticks, key, t, tie, value, shift)
    exact, gap = F.col("before.t") == F.col("target"), F.col("after.t") - F.col("before.t")
    share = (F.col("target") - F.col("before.t")) / gap
    line = F.col("before.value") + (F.col("after.value") - F.col("before.value")) * share
    return found.select(
        *anchors.columns,
        F.when(exact, F.col("before.value").cast("double")).when(gap <= max_gap, line).alias("line_value"),
        F.when(exact, "observed").when(gap <= max_gap, "interpolated").when(F.col("before").isNull() | F.col("after").isNull(), "one_sided").otherwise("too_far_apart").alias("source"),
    )


def interval_semi(probes: DataFrame, ticks: DataFrame, key: str, t: str, horizons: list[tuple[str, int, int]]) -> DataFrame:
    """Per time (key, t) that probes have and horizon (name, after, tolerance): whether a tick lies in [t + after - tolerance, t + after + tolerance] and after t.

    Probes of one key and time ask the same, so they give one row; those without a time see nothing. Counting ticks at or before each end of the interval in the key's stream answers it without pairs.
    """
    out = None
    for name, after, tolerance in horizons:
        low, high = F.greatest(F.col(t) + (after - tolerance) - 1, F.col(t)), F.col(t) + after + tolerance
        ends = probes.select(key, F.col(t).alias("_at"), F.explode(F.array(F.struct(low.alias("e"), F.lit(-1).alias("s")), F.struct(high.alias("e"), F.lit(1).alias("s")))).alias("x")).select(key, "_at", F.col("x.e").alias(t), F.col("x.s").alias("sign"))
        stream = ends.unionByName(ticks.select(key, t).withColumn("sign", F.lit(0)), allowMissingColumns=True)
        seen = F.sum(F.when(F.col("sign") == 0, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(t).rangeBetween(Window.unboundedPreceding, 0))
        hits = stream.withColumn("seen", seen).where("sign <> 0").groupBy(key, F.col("_at").alias(t)).agg(F.sum(F.col("seen") * F.col("sign")).alias("hits"), F.count("*").alias("ends"))
        part = hits.select(key, t, F.lit(name).alias("horizon"), (F.col("hits") > 0).alias("observed"))
        out = part if out is None else out.unionByName(part)
    return out
