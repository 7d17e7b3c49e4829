"""Reliability of probability forecasts: bins, errors, decomposition, skill, cohorts.

Forecasts are rows (id, p, y) with p in thousandths and y in 0, 1, both whole numbers, so sums are exact
in any order; bins are aggregated in one shuffle of at most ``bins`` rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import stats

BINS = 10
SCALE = 1000


def bin_of(p: Column, bins: int = BINS) -> Column:
    return stats.probability_bin(p / F.lit(float(SCALE)), bins)


def bins(forecasts: DataFrame, keys: list[str] = [], n_bins: int = BINS) -> DataFrame:  # noqa: B006
    """Per key and bin: n, sum_p, yes, sum_brier (in millionths), all exact."""
    d = F.col("p") - SCALE * F.col("y")
    return forecasts.groupBy(*keys, bin_of(F.col("p"), n_bins).alias("bin")).agg(F.count("*").alias("n"), F.sum("p").alias("sum_p"), F.sum("y").alias("yes"), F.sum(d * d).alias("sum_brier"))


def reliability(binned: DataFrame) -> DataFrame:
    """Each bin's mean forecast, observed rate, gap, Wilson interval, direction and label."""
    mean_p, rate = F.col("sum_p") / F.col("n") / SCALE, F.col("yes") / F.col("n")
    low, high = stats.wilson(F.col("yes"), F.col("n"))
    return binned.select(
        "*", mean_p.alias("mean_p"), rate.alias("rate"), (mean_p - rate).alias("gap"), low.alias("low"), high.alias("high"),
        L.calibration_direction(mean_p, rate).alias("direction"), L.ladder(F.col("n"), [(3, "too_thin"), (10, "descriptive_only")], "measured").alias("label"),
    )


def errors(binned: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """ECE, and MCE over measured bins or else over all; ``mce_source`` says which."""
    gap = F.abs(F.col("sum_p") / SCALE - F.col("yes"))
    measured = F.max(F.when(F.col("n") >= 10, gap / F.col("n")))
    return binned.groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum(gap) / F.sum("n")).alias("ece"), F.coalesce(measured, F.max(gap / F.col("n"))).alias("mce"),
        F.when(measured.isNotNull(), "measured").otherwise("fallback_populated").alias("mce_source"), F.count("*").alias("populated_bins"),
    )


def decomposition(binned: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Reliability, resolution and uncertainty, the Brier score and what binning leaves; one pass over the bins.

    Uses sum n*(rate - base)^2 = sum yes^2/n - yes^2/n, so that no second pass joins the base rate.
    """
    n, p, yes = F.sum("n").cast("double"), F.col("sum_p") / SCALE, F.col("yes")
    reliability_ = F.sum((p - yes) * (p - yes) / F.col("n")) / n
    base = F.sum("yes") / n
    resolution = F.sum(yes * yes / F.col("n")) / n - base * base
    actual = F.sum("sum_brier") / F.lit(float(SCALE * SCALE)) / n
    return binned.groupBy(*keys).agg(
        F.sum("n").alias("n"), reliability_.alias("reliability"), resolution.alias("resolution"), (base * (1 - base)).alias("uncertainty"), actual.alias("brier"),
        (actual - (reliability_ - resolution + base * (1 - base))).alias("residual"),
    )


def skill(forecasts: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The Brier score against always one half and against always the base rate."""
    n, d = F.count("*").cast("double"), F.col("p") - SCALE * F.col("y")
    brier, base = F.sum(d * d) / F.lit(float(SCALE * SCALE)) / n, F.sum("y") / n
    return forecasts.groupBy(*keys).agg(
        F.count("*").alias("n"), brier.alias("brier"), base.alias("base_rate"), (1 - brier / 0.25).alias("skill_vs_half"),
        F.when(base * (1 - base) > 0, 1 - brier / (base * (1 - base))).alias("skill_vs_base"),
    )


def directional_shares(binned: DataFrame) -> DataFrame:
    """Shares of forecasts in over-, underconfident and calibrated bins, in ten-thousandths that add up to 10,000 by the largest one."""
    rows = reliability(binned)
    n = F.sum("n")
    share = lambda names: F.round(F.sum(F.when(F.col("direction").startswith(names), F.col("n")).otherwise(0)) * 10_000 / n).cast("long")
    out = rows.agg(share("over").alias("over"), share("under").alias("under"), share("approx").alias("calibrated"))
    rest = 10_000 - (F.col("over") + F.col("under") + F.col("calibrated"))
    most = F.greatest("over", "under", "calibrated")
    first = F.when(F.col("over") == most, "over").when(F.col("under") == most, "under").otherwise("calibrated")
    return out.select(*[(F.col(c) + F.when(first == c, rest).otherwise(0)).alias(c) for c in ("over", "under", "calibrated")])


def trend(periods: DataFrame, least: int, tolerance: float) -> Column:
    """improving, worsening or stable from early to late error; unknown where a half is thin."""
    early, late = F.col("early"), F.col("late")
    return F.when((F.col("n_early") < least) | (F.col("n_late") < least), "insufficient").when(late - early > tolerance, "worsening").when(early - late > tolerance, "improving").otherwise("stable")


#: Fixed value: forecasts below which a cohort is too thin to read.
LEAST_COHORT = 20


def cohorts(binned: DataFrame, key: str, limit: int) -> DataFrame:
    """Per cohort, of bins by ``key``: size, errors, Brier score against one half and the base rate, decomposition, and share of all; the largest ones, ties by name."""
    each = errors(binned, [key]).join(decomposition(binned, [key]).drop("n", "residual"), key).join(binned.groupBy(key).agg((F.sum("yes") / F.sum("n")).alias("prevalence")), key)
    total = binned.agg(F.sum("n").alias("total"))
    spread = F.col("prevalence") * (1 - F.col("prevalence"))
    to = lambda c, places=6: F.round(c, places)
    out = each.join(F.broadcast(total)).select(
        key, "n", to(F.col("prevalence")).alias("prevalence"), to(F.col("brier")).alias("brier"), F.lit(0.25).alias("neutral_brier"), to(spread).alias("base_brier"),
        to(F.when(spread > 0, 1 - F.col("brier") / spread)).alias("skill"), *[to(F.col(c)).alias(c) for c in ("ece", "mce")], "populated_bins", *[to(F.col(c)).alias(c) for c in ("reliability", "resolution")],
        to(F.col("n") / F.col("total"), 4).alias("share"), F.when(F.col("n") >= LEAST_COHORT, "measured").otherwise("too_thin").alias("label"),
    )
    return out.orderBy(F.desc("n"), key).limit(limit)
