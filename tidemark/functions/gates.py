"""Gates that were registered before their windows, and the state of a policy under them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the measurement contract.
LEAST_READABLE, LEAST_VALIDATED, PREFERRED = 12, 75, 150
TOWARD, FAILING_TOWARD = 0.55, 0.50
KEY_SHARE, GAME_SHARE = 0.34, 0.50


def window_type(start: Column, end: Column, lock: Column) -> Column:
    """validation from the lock on, discovery up to it; a window that holds the lock inside is mixed."""
    return F.when(start >= lock, "validation").when(end <= lock, "discovery").otherwise("mixed")


def gates(n: Column, toward: Column, closure: Column, key_share: Column, game_share: Column, window: Column) -> dict[str, Column]:
    """Each gate by name; an unknown rate or closure does not pass, an unknown share does."""
    known = lambda c: F.coalesce(c, F.lit(False))
    return {
        "sample_n_ge_75": n >= LEAST_VALIDATED,
        "sample_n_ge_150_preferred": n >= PREFERRED,
        "toward_60m_ge_0_55": known(toward >= TOWARD),
        "closure_60m_positive": known(closure > 0),
        "max_ticker_share_le_0_34": F.coalesce(key_share, F.lit(0.0)) <= KEY_SHARE,
        "max_game_share_le_0_50": F.coalesce(game_share, F.lit(0.0)) <= GAME_SHARE,
        "out_of_sample_window": window == "validation",
    }


def status(role: Column, n: Column, toward: Column, closure: Column, key_share: Column, game_share: Column, window: Column) -> Column:
    """A policy's state: baselines are no candidates, controls should stay adverse, and only a validation window validates."""
    g = gates(n, toward, closure, key_share, game_share, window)
    adverse = F.coalesce(toward < FAILING_TOWARD, F.lit(False)) | F.coalesce(closure < 0, F.lit(False))
    crowded = ~g["max_ticker_share_le_0_34"] | ~g["max_game_share_le_0_50"]
    passes = g["sample_n_ge_75"] & g["toward_60m_ge_0_55"] & g["closure_60m_positive"]
    control = F.when(n < LEAST_READABLE, "insufficient_sample").when(adverse, "control_consistent").otherwise("control_anomaly")
    candidate = (
        F.when(n < LEAST_READABLE, "sample_collapsed").when(adverse | crowded, "failing_gates")
        .when(passes, F.when(window == "validation", "validated_shadow").otherwise("passes_gates_discovery_only"))
        .when(n < LEAST_VALIDATED, "insufficient_sample").otherwise("inconclusive_continue_observing")
    )
    return F.when(role == "baseline", "baseline").when(role == "negative_control", control).otherwise(candidate)
