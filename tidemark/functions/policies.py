"""Filters over measured rows, stated as SQL conditions, and the readings of what they keep.

An *exclude* condition keeps rows whose fact is unknown; a *require* or *only* condition drops them. The
conditions are plain SQL over the columns of a watchlist row, so that a plan and its check say the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import stats

# Fixed values of the measurement contract: names of policies, their order and limits.
LEFT_OUT_SERIES = "KXMLBSPREAD"
FOLLOWS = "coalesce(relation = 'follows_move', false)"
SHARP = "coalesce(abs(pre_move) >= 300, false)"

#: Eighteen filters on how a gap lies to the move before it; moves and prices in hundredths of a cent, spread and liquidity in cents.
FILTERS = {
    "baseline_all_watchlist": "true",
    "exclude_gap_opposes_recent_move": "coalesce(relation <> 'opposes_move', true)",
    "require_gap_follows_recent_move": FOLLOWS,
    "exclude_sharp_pre_move": f"NOT {SHARP}",
    "require_no_sharp_pre_move": f"pre_move IS NOT NULL AND NOT {SHARP}",
    "exclude_price_move_threshold": "coalesce(signal_type <> 'price_move_threshold', true)",
    "exclude_spread_markets": "coalesce(market_type <> 'spread', true)",
    "spread_only": "coalesce(market_type = 'spread', false)",
    "total_only": "coalesce(market_type = 'total', false)",
    "winner_only": "coalesce(market_type = 'winner', false)",
    "totals_only_no_sharp_pre_move": f"coalesce(market_type = 'total', false) AND NOT {SHARP}",
    "gap_follows_move_and_tight_spread": f"{FOLLOWS} AND coalesce(spread_cents <= 2, false)",
    "gap_follows_move_and_high_liquidity": f"{FOLLOWS} AND coalesce(liquidity_cents >= 1000000, false)",
    "gap_follows_move_and_persistence_gt1": f"{FOLLOWS} AND coalesce(persistence > 1, false)",
    "exclude_kxmlbspread": f"coalesce(series <> '{LEFT_OUT_SERIES}', true)",
    "exclude_worst_series": "coalesce(series <> worst_series, true)",
    "require_gap_follows_move_exclude_spreads": f"{FOLLOWS} AND coalesce(market_type <> 'spread', true)",
    "require_gap_follows_move_totals_only": f"{FOLLOWS} AND coalesce(market_type = 'total', false)",
}

_NOT_WINNER, _NOT_LATE = "coalesce(market_type <> 'winner', true)", "coalesce(phase <> 'late', true)"
_NOT_SURE, _NOT_MIDDLING = "confidence_bucket <> '0.65+'", "liquidity_bucket <> '1M-10M'"
_GAP_KNOWN, _SMALL_GAP = "coalesce(abs(gap) <= 1500, false)", "gap_bucket IN ('0.05-0.075', '0.075-0.10')"
_SPREAD, _THIN = "spread_bucket IN ('2', '3-5')", "liquidity_bucket = '<100k'"

#: Thirteen filters on buckets of gap, confidence, spread, liquidity and phase.
COHORT_FILTERS = {
    "baseline_all_watchlist": "true",
    "exclude_winner": _NOT_WINNER,
    "exclude_late_game": _NOT_LATE,
    "exclude_confidence_065_plus": _NOT_SURE,
    "exclude_abs_gap_gt_015": _GAP_KNOWN,
    "exclude_liquidity_1m_10m": _NOT_MIDDLING,
    "small_gap_only_005_010": _SMALL_GAP,
    "spread_2_5c_only": _SPREAD,
    "liquidity_lt_100k_only": _THIN,
    "totals_only": "coalesce(market_type = 'total', false)",
    "spreads_only": "coalesce(market_type = 'spread', false)",
    "exclude_all_current_bad_cohorts": " AND ".join((_NOT_WINNER, _NOT_LATE, _NOT_SURE, _GAP_KNOWN, _NOT_MIDDLING, "coalesce(persistence <> 2, true)")),
    "conservative_candidate_policy": " AND ".join((_NOT_WINNER, _NOT_LATE, _GAP_KNOWN, _NOT_MIDDLING, "coalesce(market_type IN ('spread', 'total'), false)", _SMALL_GAP, f"({_SPREAD} OR {_THIN})")),
}


def confidence_bucket(share: Column) -> Column:
    return F.when(share.isNull(), "unknown").when(share < 0.60, "<0.60").when(share < 0.65, "0.60").otherwise("0.65+")


def game_phase(tags: Column) -> Column:
    """late, mid or early by the first of these tags that a row has; without one, or without tags: unknown."""
    out = F.when(F.lit(False), "")
    for phase in ("late", "mid", "early"):
        out = out.when(F.coalesce(F.array_contains(tags, f"{phase}_game"), F.lit(False)), phase)
    return out.otherwise("unknown")


def game_of(ticker: Column) -> Column:
    """The game within a ticker: its second part between dashes; a ticker without one is its own game."""
    return F.coalesce(F.get(F.split(ticker, "-"), F.lit(1)), ticker)


def filter_label(n: Column, toward_30: Column, toward_60: Column, closure_60: Column, base_60: Column, survival: Column, key_share: Column, game_share: Column) -> Column:
    """How a filter reads: few samples and narrow filters are told apart from bad ones, concentration from strength."""
    clears = (F.coalesce(toward_30, F.lit(0.0)) >= 0.55) | (F.coalesce(toward_60, F.lit(0.0)) >= 0.55) | F.coalesce(closure_60 >= 0.10, F.lit(False))
    spread = (F.coalesce(key_share, F.lit(0.0)) <= 0.34) & (F.coalesce(game_share, F.lit(0.0)) <= 0.50)
    return (
        F.when((n >= 30) & clears, F.when(spread, "promising_shadow").otherwise("neutral"))
        .when(((n >= 12) & clears) | (n < 12), "too_thin")
        .when(F.coalesce(survival, F.lit(0.0)) < 0.10, "reject_policy")
        .when(F.coalesce(toward_60 < base_60 - 0.03, F.lit(False)), "worse_than_baseline")
        .otherwise("neutral")
    )


def mean(value: Column) -> Column:
    """The mean of known values to 4 places; null where none is known."""
    return F.round(F.avg(value), 4)


def toward_rate(closure: Column) -> Column:
    return stats.rate(stats.count_where(closure > 0), F.count(closure))
