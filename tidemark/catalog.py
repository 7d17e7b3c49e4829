"""All registered queries of the core package, by name."""

from __future__ import annotations

from .plans import archive, evidence, fills, forecasting, landed, market, policies, records, reports, states, streams, timing, tokens, venues
from .plans.registry import QUERIES, SQL, Query

__all__ = ["archive", "evidence", "fills", "forecasting", "landed", "market", "oracle_sql", "policies", "queries", "records", "reports", "states", "streams", "timing", "tokens", "venues"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
