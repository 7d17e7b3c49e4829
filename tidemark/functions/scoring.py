"""Scores and costs as column expressions; a missing input gives the stated neutral value or null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking contract.
WEIGHTS = {"spread": 0.30, "liquidity": 0.25, "volume": 0.20, "expiration": 0.15, "clarity": 0.10}
LIQUIDITY_CEILING = 1_000_000
VOLUME_CEILING = 100_000
EXPIRATION_DAYS = (0.25, 1.0, 30.0, 180.0)


def spread_score(spread: Column) -> Column:
    """max(0, 1 - spread / 100); null or negative gives 0."""
    return F.when(spread >= 0, F.greatest(F.lit(0.0), 1 - spread / F.lit(100.0))).otherwise(F.lit(0.0))


def log_score(value: Column, ceiling: float) -> Column:
    """log1p(value) over log1p(ceiling), at most 1; null or not positive gives 0."""
    return F.when(value > 0, F.least(F.lit(1.0), F.log1p(value) / F.log1p(F.lit(float(ceiling))))).otherwise(F.lit(0.0))


def trapezoid(days: Column, edges: tuple[float, float, float, float] = EXPIRATION_DAYS) -> Column:
    """0 outside the first and last edge, 1 between the inner ones, straight in between; null gives 0."""
    low, rise, fall, high = (F.lit(x) for x in edges)
    return (
        F.when(days.isNull() | (days <= low) | (days >= high), F.lit(0.0))
        .when(days < rise, (days - low) / (rise - low))
        .when(days <= fall, F.lit(1.0))
        .otherwise((high - days) / (high - fall))
    )


def weighted_composite(parts: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted mean of the parts, by name."""
    return reduce(lambda a, b: a + b, (parts[k] * F.lit(w) for k, w in weights.items())) / F.lit(sum(weights.values()))


def mean_of_available(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that are not null; null if none is."""
    total = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) * F.lit(w) for c, w in parts))
    weight = reduce(lambda a, b: a + b, (F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts))
    return F.when(weight > 0, total / weight)


def growth(current: Column, previous: Column) -> Column:
    """(current - previous) / previous; null where the previous value is null or 0."""
    return F.try_divide(current - previous, previous)


def round_trip_fee(p_start: Column, p_end: Column, rate: float) -> Column:
    """rate * p * (1 - p), charged at both ends."""
    return F.lit(rate) * (p_start * (1 - p_start) + p_end * (1 - p_end))


def toward_move(start: Column, end: Column, gap: Column) -> Column:
    """The move's part in the direction of the gap; positive is toward."""
    return F.when(gap > 0, end - start).otherwise(start - end)


def touch_move(bid_start: Column, ask_start: Column, bid_end: Column, ask_end: Column, gap: Column) -> Column:
    """Toward move between prices that could be had: from ask to bid upward, from bid to ask downward; null where a side is missing."""
    return F.when(gap > 0, bid_end - ask_start).otherwise(bid_start - ask_end)


def brier(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def log_loss(p: Column, y: Column, eps: float = 1e-15) -> Column:
    clamped = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(y * F.log(clamped) + (1 - y) * F.log(1 - clamped))
