"""Aggregates and intervals with explicit empties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """part / whole; null on an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson score interval of k in n, within [0, 1]; null on n = 0."""
    n = F.when(n > 0, n.cast("double"))
    share = k / n
    scale = 1 + z * z / n
    middle = (share + z * z / (2 * n)) / scale
    margin = (z / scale) * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), middle - margin)), F.when(n.isNotNull(), F.least(F.lit(1.0), middle + margin))


def probability_bin(p: Column, bins: int) -> Column:
    """The bin of p by the explicit edges round(k / bins, 10): closed below, the last one closed above; null outside [0, 1]."""
    out = F.when((p < 0) | (p > 1) | p.isNull(), F.lit(None).cast("int"))
    for k in range(bins - 1, 0, -1):
        out = out.when(p >= round(k / bins, 10), F.lit(k))
    return out.otherwise(F.lit(0))
