"""States of forecasts and their outcomes, each with an explicit place for what contradicts itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words for outcomes, sides and scores.
OUTCOMES = ("open", "closed", "settled", "canceled", "unknown")
SIDES = ("yes", "no", "void", "unknown")
SCORES = ("scored", "pending_outcome", "unscorable")
STALE_OPEN_SECONDS = 6 * 3600


def truth(outcome: Column, side: Column, resolved: Column) -> Column:
    """1 or 0 of a settled outcome whose recorded probability, if any, agrees with its side; else null."""
    y = F.when(side == "yes", 1.0).when(side == "no", 0.0)
    return F.when((outcome == "settled") & (resolved.isNull() | (resolved == y)), y)


def score_target(outcome: Column, side: Column, resolved: Column) -> Column:
    """What an outcome's forecast should be: pending_outcome, scored or unscorable."""
    return (
        F.when(outcome.isNull() | outcome.isin("open", "closed"), "pending_outcome")
        .when(truth(outcome, side, resolved).isNotNull(), "scored").otherwise("unscorable")
    )


def _among(value: Column, words: tuple[str, ...]) -> Column:
    return value.isNull() | value.isin(*words)


def scorability(outcome: Column, side: Column, resolved: Column, score: Column, brier: Column, recomputed: Column) -> Column:
    """One of twelve states of a forecast by its latest outcome and its latest score.

    ``brier`` is the stored score and ``recomputed`` the one of today's outcome: where they differ the
    score is stale. Words that aren't known make the state inconsistent before anything else is looked at.
    """
    target = score_target(outcome, side, resolved)
    current = F.coalesce((score == "scored") & (brier == recomputed), F.lit(False))
    return (
        F.when(~_among(outcome, OUTCOMES) | ~_among(score, SCORES) | ((outcome == "settled") & ~_among(side, SIDES)), "state_inconsistent")
        .when(target == "scored", F.when(score.isNull(), "scorable_score_missing").when(current, "scored_current").otherwise("scorable_score_stale"))
        .when(target == "pending_outcome", F.when(score.isNotNull() & (score != "pending_outcome"), "pending_score_stale").when(outcome.isNull(), "pending_no_outcome").when(outcome == "open", "pending_market_open").otherwise("pending_market_closed_unsettled"))
        .when(score.isNotNull() & (score != "unscorable"), "unscorable_score_stale")
        .when(outcome == "canceled", "unscorable_canceled").when(outcome == "unknown", "unscorable_unknown").otherwise("unscorable_void_or_missing_winner")
    )


def missing_reason(has_market: Column, outcome: Column, side: Column, resolved: Column, close_age: Column, attempted: Column, failed: Column) -> Column:
    """Why a matured forecast has no usable outcome, one of twelve reasons by precedence; null where it has one."""
    side = F.nullif(F.lower(F.trim(side)), F.lit(""))
    status = F.lower(F.trim(outcome))
    settled = (
        F.when(side.isin("yes", "no"), F.when(resolved.isNotNull() & truth(status, side, resolved).isNull(), "local_outcome_conflict"))
        .when(side == "void", "market_void").when(side.isNull() | (side == "unknown"), "winner_missing").otherwise("winner_ambiguous")
    )
    return (
        F.when(~has_market, "state_inconsistent")
        .when(outcome.isNull(), F.when(failed, "sync_error").when(attempted, "provider_market_missing").otherwise("sync_never_attempted"))
        .when(status == "settled", settled)
        .when(status == "canceled", F.when(side == "void", "market_void").otherwise("market_canceled"))
        .when(status == "closed", "market_closed_unsettled")
        .when(status == "open", F.when(close_age >= STALE_OPEN_SECONDS, "local_outcome_stale").otherwise("market_closed_unsettled"))
        .otherwise("provider_status_unrecognized")
    )
