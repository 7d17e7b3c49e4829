"""Six readings of one wide row per token, stated as SQL over its columns, so that a plan and its check say the same.

A reading is the mean of the parts that a row has, each between 0 and 1, with the reasons that hold; what a row lacks is no part. Risk is the
worst of its penalties, as a mean would dilute a severe one.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Agent:
    """parts: SQL of each part, null where the row has none; reasons: names and when they hold; empty: the score without parts."""

    parts: tuple[str, ...]
    reasons: tuple[tuple[str, str], ...]
    empty: float

    def score(self) -> str:
        total = " + ".join(f"coalesce({p}, 0.0)" for p in self.parts)
        known = " + ".join(f"CASE WHEN ({p}) IS NULL THEN 0 ELSE 1 END" for p in self.parts)
        return f"CASE WHEN {known} = 0 THEN {self.empty} ELSE round(least(1.0, greatest(0.0, ({total}) / nullif({known}, 0))), 4) END"


def _clamped(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN least(1.0, greatest(0.0, {x})) END"


# Limits of concentrations in per cent, and the weights, bands and gates of a profile.
LIMITS = {"top10": 40, "sniper": 20, "insider": 15, "bundler": 25}
CONCENTRATION, SUSPICION, NO_COVERAGE, BANDS = 0.7, 0.6, 0.55, ((0.68, "high_review"), (0.38, "elevated_review"), (0.20, "monitor"))
LEAST_MOMENTUM, LEAST_STRUCTURE, LEAST_COVERAGE, MOST_RISK = 0.6, 0.6, 0.5, 0.4

STRUCTURE = Agent(
    (
        "CASE WHEN liquidity >= 50000 THEN 1.0 WHEN liquidity >= 5000 THEN 0.6 WHEN liquidity IS NOT NULL THEN 0.25 END", "CASE WHEN volume >= 100000 THEN 1.0 WHEN volume >= 10000 THEN 0.6 WHEN volume IS NOT NULL THEN 0.3 END",
        f"CASE WHEN top10 <= 20 THEN 1.0 WHEN top10 <= {LIMITS['top10']} THEN 0.55 WHEN top10 IS NOT NULL THEN 0.2 END", *(f"CASE WHEN {n} > {LIMITS[n]} THEN 0.2 WHEN {n} IS NOT NULL THEN 0.9 END" for n in ("sniper", "insider", "bundler")),
        "CASE WHEN rug THEN 0.0 END", "CASE WHEN honeypot THEN 0.0 END", "CASE WHEN mint_open THEN 0.4 END", "CASE WHEN freeze_open THEN 0.4 END",
    ),
    (
        ("healthy_liquidity", "liquidity >= 5000"), ("thin_liquidity", "liquidity < 5000"), ("low_volume", "volume < 10000"), ("high_top10_concentration", f"top10 > {LIMITS['top10']}"),
        *((f"{n}_concentration_flagged", f"{n} > {LIMITS[n]}") for n in ("sniper", "insider", "bundler")), ("rug_flag", "rug"), ("honeypot_flag", "honeypot"), ("mint_authority_active", "mint_open"), ("freeze_authority_active", "freeze_open"), ("weak_provider_coverage", "confidence < 0.3"),
    ),
    0.3,
)
VELOCITY = Agent(
    (
        _clamped("attention"), "CASE WHEN round(attention - attention_before, 4) >= 0.15 THEN least(1.0, 0.5 + round(attention - attention_before, 4)) WHEN round(attention - attention_before, 4) <= -0.15 THEN 0.3 END", "CASE WHEN boost > 0 THEN 0.7 END", "CASE WHEN boost_velocity > 0 THEN 0.7 END",
        "CASE WHEN social THEN 0.7 END", "CASE WHEN catalysts >= 3 THEN 0.8 WHEN catalysts = 0 THEN 0.3 END", _clamped("profile"),
    ),
    (
        ("strong_attention", "attention >= 0.6"), ("weak_attention", "attention < 0.3"), ("attention_rising", "round(attention - attention_before, 4) >= 0.15"), ("attention_fading", "round(attention - attention_before, 4) <= -0.15"), ("boosted", "boost > 0"),
        ("no_social_metadata", "NOT coalesce(social, false)"), ("frequent_catalysts", "catalysts >= 3"), ("no_catalysts", "catalysts = 0"),
    ),
    0.2,
)
TIMING = Agent(
    ("CASE WHEN age < 21600 THEN 0.9 WHEN age < 172800 THEN 0.6 WHEN age IS NOT NULL THEN 0.35 END", _clamped("(0.5 + liquidity_growth)"), _clamped("(0.5 + volume_growth)"), "CASE WHEN boost_velocity > 0 THEN 0.7 END", "CASE WHEN snapshots >= 3 THEN 0.8 WHEN snapshots <= 1 THEN 0.4 END"),
    (
        ("fresh_token", "age < 21600"), ("mature_token", "age >= 172800"), ("liquidity_momentum", "liquidity_growth > 0.1"), ("liquidity_declining", "liquidity_growth < -0.1"), ("volume_momentum", "volume_growth > 0.1"), ("recent_boost", "boost_velocity > 0"), ("sustained_attention", "snapshots >= 3"),
    ),
    0.4,
)
_HELD = " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE 1 END" for n in LIMITS)
COVERAGE = Agent((f"({_HELD}) / 4.0", "CASE WHEN provided THEN 1.0 ELSE 0.0 END", _clamped("confidence")), (("no_holder_dimensions", f"({_HELD}) = 0"), ("missing_provider_coverage", "NOT coalesce(provided, false)")), 0.0)

_PENALTIES = (
    ("severe_risk_level", "level = 'severe'", 1.0), ("high_risk_level", "level = 'high'", 0.8), ("high_top10_concentration", f"top10 > {LIMITS['top10']}", CONCENTRATION), *((f"{n}_concentration", f"{n} > {LIMITS[n]}", CONCENTRATION) for n in ("sniper", "insider", "bundler")),
    ("rug_flag", "rug", 1.0), ("honeypot_flag", "honeypot", 1.0), ("fake_volume", "fake_volume", SUSPICION), ("liquidity_removed", "removed", SUSPICION), ("suspicious_volume", "spike", SUSPICION), ("missing_provider_coverage", "NOT coalesce(provided, false)", NO_COVERAGE), ("provider_unknown", "unknown_provider", 0.2),
)
RISK_REASONS = tuple((n, c) for n, c, _ in _PENALTIES)
RISK = "greatest(CASE WHEN level = 'medium' THEN 0.4 ELSE 0.0 END, " + ", ".join(f"CASE WHEN {c} THEN {w} ELSE 0.0 END" for _, c, w in _PENALTIES) + ")"

#: Over the scores of the others: what momentum is, whether a token is rejected, the review score (to as many places as it can have, so that none is a tie of rounding), and the gates of the highest band.
MOMENTUM = "round(0.6 * velocity + 0.4 * timing, 4)"
REJECTED = "risk >= 0.8"
REVIEW = f"CASE WHEN {REJECTED} THEN 0.0 ELSE round(least(1.0, greatest(0.0, (0.55 * momentum + 0.45 * structure) * (1 - risk))), 8) END"
_RAW = "least(1.0, greatest(0.0, (0.55 * momentum + 0.45 * structure) * (1 - risk)))"
_CLEAN = " AND ".join(f"NOT coalesce({n} > {m}, false)" for n, m in LIMITS.items())
GATES = f"momentum >= {LEAST_MOMENTUM} AND structure >= {LEAST_STRUCTURE} AND coverage >= {LEAST_COVERAGE} AND risk <= {MOST_RISK} AND {_CLEAN} AND coalesce(provided, false)"
PRIORITY = f"CASE WHEN {REJECTED} THEN 'reject_risk' WHEN {_RAW} >= {BANDS[0][0]} THEN CASE WHEN {GATES} THEN '{BANDS[0][1]}' ELSE '{BANDS[1][1]}' END WHEN {_RAW} >= {BANDS[1][0]} THEN '{BANDS[1][1]}' WHEN {_RAW} >= {BANDS[2][0]} THEN '{BANDS[2][1]}' ELSE 'low' END"
