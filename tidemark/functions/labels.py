"""Ladders of labels and reason lists; unknown inputs have a label of their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the measurement contract.
AWAY, TOWARD = -0.25, 0.25
SHARP_MOVE = 0.03
NOTHING = 1e-9


def ladder(value: Column, steps: list[tuple[float, str]], above: str, unknown: str = "unknown", closed: bool = False) -> Column:
    """The label of the first step that the value lies below (at or below if ``closed``); else ``above``; null: ``unknown``."""
    out = F.when(value.isNull(), F.lit(unknown))
    for edge, label in steps:
        out = out.when(value <= edge if closed else value < edge, F.lit(label))
    return out.otherwise(F.lit(above))


def gap_bucket(gap: Column) -> Column:
    return ladder(gap, [(0.05, "<0.05"), (0.075, "0.05-0.075"), (0.10, "0.075-0.10"), (0.15, "0.10-0.15")], ">0.15", "none")


def liquidity_bucket(cents: Column) -> Column:
    return ladder(cents, [(100_000, "<100k"), (1_000_000, "100k-1M"), (10_000_000, "1M-10M")], ">10M")


def spread_bucket(cents: Column) -> Column:
    return ladder(cents, [(1, "1"), (2, "2"), (5, "3-5"), (10, "6-10")], ">10", closed=True)


def age_bucket(seconds: Column) -> Column:
    return ladder(seconds, [(120, "<2m"), (300, "2-5m"), (900, "5-15m")], ">15m")


def path_class(closure: Column) -> Column:
    return F.when(closure.isNull(), "no_sample").when(closure <= AWAY, "continued_away").when(closure >= TOWARD, "reverted_toward").otherwise("flat")


def gap_relation(gap: Column, pre_move: Column) -> Column:
    """Whether a gap points against or along the move before it."""
    return (
        F.when(gap.isNull() | pre_move.isNull(), "unknown")
        .when(F.abs(pre_move) < NOTHING, "no_pre_move")
        .when(F.abs(gap) < NOTHING, "no_gap")
        .when((gap > 0) != (pre_move > 0), "opposes_move")
        .otherwise("follows_move")
    )


def adjustment(forecast_move: Column, market_move: Column, least_forecast: float = 0.01, least_market: float = 0.02, partial: float = 0.5) -> Column:
    """How a forecast moved with its market: static, anchored, partial, with or against."""
    return (
        F.when(forecast_move.isNull() | market_move.isNull(), "unclassifiable")
        .when(F.abs(market_move) < least_market, "market_static")
        .when(F.abs(forecast_move) < least_forecast, "anchored")
        .when((forecast_move > 0) != (market_move > 0), "moved_against")
        .when(F.abs(forecast_move) < partial * F.abs(market_move), "partial")
        .otherwise("moved_with")
    )


def quote_quality(bid: Column, ask: Column) -> Column:
    spread = ask - bid
    return F.when(spread.isNull(), "missing_quotes").when(spread >= 5, "wide").when(spread >= 3, "moderate").otherwise("tight")


def volatility_state(limits: list[tuple[Column, float]], basis: list[Column]) -> Column:
    """volatile if any measured move reaches its limit; insufficient where no basis is measured; else calm."""
    hit = F.lit(False)
    for value, limit in limits:
        hit = hit | F.coalesce(F.abs(value) >= limit, F.lit(False))
    return F.when(hit, "volatile").when(F.coalesce(*basis).isNull(), "insufficient").otherwise("calm")


def risk_level(score: Column) -> Column:
    return ladder(score, [(0.25, "low"), (0.5, "medium"), (0.75, "high")], "severe")


def reasons(checks: list[tuple[Column, str]]) -> Column:
    """The names of the checks that hold, in order; a null check does not hold."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in checks]), lambda x: x.isNotNull())


def first_reason(checks: list[tuple[Column, str]], otherwise: str) -> Column:
    """The first check that holds, by precedence."""
    out = F.when(checks[0][0], F.lit(checks[0][1]))
    for c, name in checks[1:]:
        out = out.when(c, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def follow_label(samples: Column, toward_rate: Column) -> Column:
    """The reading of a cohort: too_thin below 12 samples, then by its toward rate."""
    return (
        F.when((samples < 12) | toward_rate.isNull(), "too_thin")
        .when(toward_rate >= 0.55, "promising").when(toward_rate <= 0.35, "exclude").when(toward_rate < 0.45, "weak").otherwise("neutral")
    )


def sample_label(n: Column) -> Column:
    return ladder(n, [(30, "insufficient_sample"), (100, "early_signal"), (300, "useful_sample")], "stronger_sample")


def calibration_direction(mean_p: Column, rate: Column, tolerance: float = 0.05) -> Column:
    """Over- or underconfidence on its side of one half; the gap is rounded to 6 places before it is compared."""
    gap = F.round(mean_p - rate, 6)
    return (
        F.when(gap.isNull(), None).when(F.abs(gap) <= tolerance, "approximately_calibrated")
        .when((mean_p >= 0.5) & (gap > 0), "overconfident_positive").when(mean_p >= 0.5, "underconfident_positive")
        .when(gap < 0, "overconfident_negative").otherwise("underconfident_negative")
    )
