"""Readings of tokens and their pairs: signals, states of planned observations, readiness of shared windows, quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import labels as L

SECOND = 1_000_000

# Fixed values of the measurement contract.
NEW_PAIR_HOURS, LEAST_LIQUIDITY, LEAST_VOLUME = 24, 5000, 1000
SPIKE, REMOVED, MOMENTUM, TOP10 = 3, 0.5, 15, 50
SEVERE = ("high", "critical", "severe")
RUG = ("provider_rug_flag", "provider_honeypot_flag")
HOLDER = ("high_holder_concentration", "sniper_concentration", "insider_concentration", "bundler_concentration", "creator_concentration")
SUPPLY = ("mint_authority_enabled", "freeze_authority_enabled")
HORIZONS = {"15m": 900 * SECOND, "1h": 3600 * SECOND, "6h": 21_600 * SECOND, "24h": 86_400 * SECOND}
GRACE = 45 * SECOND


def _any(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def signals(first: Column, now: Column, was: Column) -> Column:
    """Names of the nine signals that a tick sets off, in order.

    ``now`` and ``was`` are structs of a tick and the one before it (t, liquidity, volume, change, boosts);
    ``first`` says that there is none before. ``now`` also has created and risk, a struct of level, flags
    (an array of names), top10 and categories, null without an assessment: then no risk signal is set off.
    """
    liquidity, before, risk = now["liquidity"], was["liquidity"], now["risk"]
    flag = lambda *names: F.arrays_overlap(risk["flags"], F.array(*map(F.lit, names)))
    of = lambda names: F.arrays_overlap(risk["categories"], F.array(*map(F.lit, names)))
    return L.reasons([
        (first & (now["t"] - now["created"] <= NEW_PAIR_HOURS * 3600 * SECOND), "new_pair"),
        (~first & (liquidity >= LEAST_LIQUIDITY) & (before.isNull() | (before < LEAST_LIQUIDITY)), "liquidity_appeared"),
        ((before >= LEAST_LIQUIDITY) & (liquidity < before * REMOVED), "liquidity_removed"),
        ((now["volume"] >= LEAST_VOLUME) & (was["volume"] > 0) & (now["volume"] >= was["volume"] * SPIKE), "volume_spike"),
        (now["change"] >= MOMENTUM, "price_momentum"),
        ((F.coalesce(now["boosts"], F.lit(0)) > 0) & (F.coalesce(was["boosts"], F.lit(0)) == 0), "boost_detected"),
        (_any(risk["level"].isin(*SEVERE), flag("honeypot", "rug_risk"), of(RUG)), "rug_risk"),
        (_any(flag("holder_risk"), risk["top10"] >= TOP10, of(HOLDER)), "holder_risk"),
        (_any(flag("mint_authority_enabled", "freeze_authority_enabled", "suspicious_supply_control"), of(SUPPLY)), "suspicious_supply_control"),
    ])


def plan_state(observed: Column, inactive: Column, start: Column, end: Column, now: Column) -> Column:
    """What a planned observation's window [start, end] asks for now; a member without an anchor has no window and is never due."""
    return (
        F.when(observed, "already_observed").when(inactive, "inactive").when(start.isNull() | (now < start), "not_due")
        .when(now <= end, "due_now").otherwise("overdue_unobserved")
    )


def readiness(opens: Column, closes: Column, now: Column, margin: int) -> Column:
    """How ready a shared window is at ``now``: what is over comes before what is too narrow to be armed within grace and margin."""
    deadline = closes - GRACE - margin
    return (
        F.when(opens.isNull() | closes.isNull() | (opens > closes), "no_overlapping_pair").when(now > closes, "expired")
        .when((opens + GRACE > closes) | (deadline < opens) | (now > deadline), "insufficient_arm_slack")
        .when(now < opens - margin, "pair_detected_not_due").when(now < opens, "pair_ready_for_manual_preparation").otherwise("shared_due_now_ready")
    )


def eligible(price: Column, liquidity: Column) -> Column:
    """A pair that can be observed has a price and liquidity, both above zero."""
    return F.coalesce((price > 0) & (liquidity > 0), F.lit(False))


def pair_quality(price: Column, liquidity: Column, txns: Column, volume: Column, exact: Column) -> Column:
    """How well a pair can be observed: capped liquidity, activity and volume, more for the token's own pair, less where nothing happens; else null."""
    part = lambda value, most, by: F.least(value, F.lit(most)) / F.lit(by)
    score = part(liquidity, 1_000_000, 10_000.0) + F.least(txns, F.lit(1000)) * F.lit(0.2) + part(volume, 1_000_000, 20_000.0)
    score = score + F.when(exact, 25).otherwise(0) - F.when((txns > 0) | (volume > 0), 0).otherwise(50)
    return F.when(eligible(price, liquidity), F.round(score, 4))
