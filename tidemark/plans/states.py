"""Outcome and score states, representatives of two sides, weekly trends, delivery cohorts, and buckets that carry what is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L
from ..functions import scoring, states, stats
from ..operators import buckets, dedupe
from ..operators import calibration as C
from .registry import FORECASTS, TICKS, forecasts, query, table, ticks

# What the tables lack is drawn from ids, in SQL that both engines read alike.
_FACTS = {
    "outcome": "CASE WHEN id % 53 = 0 THEN 'bogus' ELSE CASE id % 7 WHEN 1 THEN 'open' WHEN 2 THEN 'closed' WHEN 3 THEN 'settled' WHEN 4 THEN 'canceled' WHEN 5 THEN 'unknown' WHEN 6 THEN 'settled' END END",
    "side": "CASE WHEN id % 59 = 0 THEN 'draw' ELSE CASE id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'void' WHEN 3 THEN 'unknown' END END",
    "resolved": "CASE WHEN id % 4 <> 0 THEN CASE WHEN id % 31 = 0 THEN CAST(0.5 AS DOUBLE) WHEN id % 5 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END",
    "score": "CASE WHEN id % 61 = 0 THEN 'bogus' ELSE CASE id % 6 WHEN 1 THEN 'scored' WHEN 2 THEN 'scored' WHEN 3 THEN 'scored' WHEN 4 THEN 'pending_outcome' WHEN 5 THEN 'unscorable' END END",
    "has_market": "id % 23 <> 0",
    "close_age": "id % 12 * 3600",
    "attempted": "id % 2 = 0",
    "failed": "id % 3 = 0",
}


@query(f"""WITH {FORECASTS}, f AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _FACTS.items())} FROM forecasts),
g AS (SELECT *, CASE WHEN outcome = 'settled' AND side = 'yes' AND coalesce(resolved, 1) = 1 THEN 1 WHEN outcome = 'settled' AND side = 'no' AND coalesce(resolved, 0) = 0 THEN 0 END AS truth FROM f),
h AS (SELECT *, CASE WHEN outcome IS NULL OR outcome IN ('open', 'closed') THEN 'pending_outcome' WHEN truth IS NOT NULL THEN 'scored' ELSE 'unscorable' END AS target, id % 8 <> 0 AS matches FROM g)
SELECT id, target, CASE WHEN outcome = 'bogus' OR score = 'bogus' OR (outcome = 'settled' AND side = 'draw') THEN 'state_inconsistent'
WHEN target = 'scored' THEN CASE WHEN score IS NULL THEN 'scorable_score_missing' WHEN score = 'scored' AND matches THEN 'scored_current' ELSE 'scorable_score_stale' END
WHEN target = 'pending_outcome' THEN CASE WHEN score <> 'pending_outcome' THEN 'pending_score_stale' WHEN outcome IS NULL THEN 'pending_no_outcome' WHEN outcome = 'open' THEN 'pending_market_open' ELSE 'pending_market_closed_unsettled' END
WHEN score <> 'unscorable' THEN 'unscorable_score_stale' WHEN outcome = 'canceled' THEN 'unscorable_canceled' WHEN outcome = 'unknown' THEN 'unscorable_unknown' ELSE 'unscorable_void_or_missing_winner' END AS state,
CASE WHEN NOT has_market THEN 'state_inconsistent' WHEN outcome IS NULL THEN CASE WHEN failed THEN 'sync_error' WHEN attempted THEN 'provider_market_missing' ELSE 'sync_never_attempted' END
WHEN outcome = 'settled' THEN CASE WHEN side IN ('yes', 'no') THEN CASE WHEN truth IS NULL THEN 'local_outcome_conflict' END WHEN side = 'void' THEN 'market_void' WHEN coalesce(side, 'unknown') = 'unknown' THEN 'winner_missing' ELSE 'winner_ambiguous' END
WHEN outcome = 'canceled' THEN CASE WHEN side = 'void' THEN 'market_void' ELSE 'market_canceled' END WHEN outcome = 'closed' THEN 'market_closed_unsettled' WHEN outcome = 'open' THEN CASE WHEN close_age >= 21600 THEN 'local_outcome_stale' ELSE 'market_closed_unsettled' END ELSE 'provider_status_unrecognized' END AS missing,
CASE WHEN p IS NULL THEN 'unknown' WHEN p < 250 THEN 'low' WHEN p < 500 THEN 'medium' WHEN p < 750 THEN 'high' ELSE 'severe' END AS level FROM h""")
def outcome_states(spark: SparkSession, d: str) -> DataFrame:
    """What a forecast should be, its state of twelve, why its outcome is missing, and the risk level."""
    f = forecasts(spark, d).select("*", *[F.expr(e).alias(n) for n, e in _FACTS.items()])
    c = F.col
    recomputed = (c("p") - 1000 * states.truth(c("outcome"), c("side"), c("resolved"))) * (c("p") - 1000 * states.truth(c("outcome"), c("side"), c("resolved")))
    stored = F.when(c("id") % 8 != 0, recomputed).otherwise(-1)
    return f.select(
        "id", states.score_target(c("outcome"), c("side"), c("resolved")).alias("target"), states.scorability(c("outcome"), c("side"), c("resolved"), c("score"), stored, recomputed).alias("state"),
        states.missing_reason(c("has_market"), c("outcome"), c("side"), c("resolved"), c("close_age"), c("attempted"), c("failed")).alias("missing"), L.risk_level(c("p") / 1000.0).alias("level"),
    )


@query(f"""WITH {FORECASTS}, s AS (SELECT unnest([{{'side': 'baseline', 'p': p}}, {{'side': 'challenger', 'p': 1000 - p}}]) AS x, id, id // 3 AS ticker, y, lang, id % 4 <> 1 AS scored FROM forecasts),
r AS (SELECT x.side AS side, ticker, max(id) AS id, arg_max(x.p, id) AS p, arg_max(y, id) AS y, arg_max(lang, id) AS lang FROM s WHERE scored AND NOT (x.side = 'challenger' AND id % 5 = 0) GROUP BY 1, 2),
j AS (SELECT a.lang, (b.p - 1000 * b.y) * (b.p - 1000 * b.y) - (a.p - 1000 * a.y) * (a.p - 1000 * a.y) AS delta FROM r a JOIN r b ON a.ticker = b.ticker AND a.id = b.id WHERE a.side = 'baseline' AND b.side = 'challenger')
SELECT lang, count(*) AS pairs, sum(delta)::DOUBLE / 1000000 / count(*) AS mean_delta, CAST(count(*) FILTER (WHERE delta < 0) AS BIGINT) AS wins, CAST(count(*) FILTER (WHERE delta > 0) AS BIGINT) AS losses, CAST(count(*) FILTER (WHERE delta = 0) AS BIGINT) AS ties,
CASE WHEN count(*) < 30 THEN 'insufficient_sample' WHEN count(*) < 100 THEN 'early_signal' WHEN count(*) < 300 THEN 'useful_sample' ELSE 'stronger_sample' END AS label FROM j GROUP BY 1""")
def champion_challenger(spark: SparkSession, d: str) -> DataFrame:
    """Each side's latest scored forecast of a ticker stands for it; two sides meet where these have the same outcome."""
    sides = F.explode(F.array(F.struct(F.lit("baseline").alias("side"), F.col("p").alias("p")), F.struct(F.lit("challenger").alias("side"), (1000 - F.col("p")).alias("p")))).alias("x")
    each = forecasts(spark, d).where("id % 4 <> 1").select("id", F.floor(F.col("id") / 3).alias("ticker"), "y", "lang", sides).select("*", "x.side", F.col("x.p").alias("q")).where("NOT (side = 'challenger' AND id % 5 = 0)")
    stands = each.groupBy("side", "ticker").agg(F.max_by(F.struct("id", "q", "y", "lang"), "id").alias("r")).select("side", "ticker", "r.*")
    square = (F.col("q") - 1000 * F.col("y")) * (F.col("q") - 1000 * F.col("y"))
    both = stands.where("side = 'baseline'").select("ticker", "id", "lang", square.alias("a")).join(stands.where("side = 'challenger'").select("ticker", "id", square.alias("b")), ["ticker", "id"])
    delta = F.col("b") - F.col("a")
    return both.groupBy("lang").agg(
        F.count("*").alias("pairs"), (F.sum(delta) / F.lit(1e6) / F.count("*")).alias("mean_delta"), stats.count_where(delta < 0).alias("wins"),
        stats.count_where(delta > 0).alias("losses"), stats.count_where(delta == 0).alias("ties"), L.sample_label(F.count("*")).alias("label"),
    )


@query("""WITH o AS (SELECT CAST(isoyear(o_orderdate) * 100 + week(o_orderdate) AS INT) AS period, count(*) AS n, sum((o_orderstatus = 'F')::INT) AS y FROM orders GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY period) AS i, count(*) OVER () AS m FROM o),
s AS (SELECT sum(y) FILTER (WHERE i <= m // 2)::DOUBLE / sum(n) FILTER (WHERE i <= m // 2) AS early, sum(y) FILTER (WHERE i > m // 2)::DOUBLE / sum(n) FILTER (WHERE i > m // 2) AS late, CAST(sum(n) FILTER (WHERE i <= m // 2) AS BIGINT) AS n_early, CAST(sum(n) FILTER (WHERE i > m // 2) AS BIGINT) AS n_late, count(*) AS weeks FROM k)
SELECT early, late, n_early, n_late, weeks, CASE WHEN n_early < 15 OR n_late < 15 THEN 'insufficient' WHEN late - early > 0.02 THEN 'worsening' WHEN early - late > 0.02 THEN 'improving' ELSE 'stable' END AS trend FROM s""")
def weekly_trend(spark: SparkSession, d: str) -> DataFrame:
    """The status rate of the early half of the ISO weeks against the late half; A22 is in weekly_reliability and reliability_trend. The window ranks weeks, not rows."""
    week = F.expr("extract(YEAROFWEEK FROM o_orderdate) * 100 + extract(WEEK FROM o_orderdate)").cast("int")
    by = table(spark, d, "orders").groupBy(week.alias("period")).agg(F.count("*").alias("n"), stats.count_where(F.col("o_orderstatus") == "F").alias("y"))
    halves = by.withColumn("first", F.row_number().over(Window.orderBy("period")) <= F.floor(F.count("*").over(Window.partitionBy()) / 2))
    part = lambda c, first: F.sum(F.when(F.col("first") == first, F.col(c)))
    out = halves.agg((part("y", True) / part("n", True)).alias("early"), (part("y", False) / part("n", False)).alias("late"), part("n", True).alias("n_early"), part("n", False).alias("n_late"), F.count("*").alias("weeks"))
    return out.withColumn("trend", C.trend(out, 15, 0.02))


@query(f"""WITH {FORECASTS}, x AS (SELECT lang, y, least(greatest(p / 1000.0::DOUBLE, 1e-15), 1 - 1e-15) AS q, p FROM forecasts)
SELECT lang, count(*) AS n, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss, round(sum((p - 1000 * y) * (p - 1000 * y))::DOUBLE / 1000000 / count(*), 6) AS brier, round(sum(abs(p - 1000 * y))::DOUBLE / 1000 / count(*), 6) AS absolute_error FROM x GROUP BY 1""")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    """Log loss with clamped probabilities, Brier score and absolute error."""
    e = F.col("p") - 1000 * F.col("y")
    n = F.count("*")
    return forecasts(spark, d).groupBy("lang").agg(n.alias("n"), F.round(F.avg(scoring.log_loss(F.col("p") / 1000.0, F.col("y"))), 6).alias("log_loss"), F.round(F.sum(e * e) / F.lit(1e6) / n, 6).alias("brier"), F.round(F.sum(F.abs(e)) / F.lit(1000.0) / n, 6).alias("absolute_error"))


_MODE = "CASE doc_id % 4 WHEN 0 THEN 'LIVE' WHEN 1 THEN 'BACKFILL' WHEN 2 THEN 'PULLED' ELSE 'UNKNOWN' END"


@query(f"SELECT {_MODE} AS mode, source, count(*) AS n, CASE WHEN {_MODE} = 'LIVE' THEN CAST(sum(n_chars) AS BIGINT) END AS lag FROM documents GROUP BY 1, 2")
def pure_cohort(spark: SparkSession, d: str) -> DataFrame:
    """Rows by delivery mode, each cohort refusing rows of another mode; only LIVE rows say anything about delays."""
    rows = table(spark, d, "documents").select(F.expr(_MODE).alias("mode"), "source", "n_chars")
    cohorts = [dedupe.cohort(part, mode) for mode, part in dedupe.by_mode(rows).items()]
    out = None
    for mode, rows_ in zip(dedupe.MODES, cohorts, strict=True):
        lag = F.sum("n_chars") if dedupe.permits(mode, "LATENCY_LEAD_LAG") else F.lit(None).cast("long")
        part = rows_.groupBy("mode", "source").agg(F.count("*").alias("n"), lag.alias("lag"))
        out = part if out is None else out.unionByName(part)
    return out


_MID = "CASE WHEN id % 3 <> 0 THEN cents END"
_SPREAD = "CASE WHEN id % 4 <> 0 THEN id % 12 END"
_LIQUIDITY = "CASE WHEN id % 5 <> 0 THEN cents * 7 END"


@query(f"""WITH {TICKS}, r AS (SELECT *, {_MID} AS mid, {_SPREAD} AS spread, {_LIQUIDITY} AS liquidity FROM ticks)
SELECT key, t - t % 3600000000 AS bucket, count(*) AS n, arg_min(mid, (t, id)) FILTER (WHERE mid IS NOT NULL) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, (t, id)) FILTER (WHERE mid IS NOT NULL) AS close,
{', '.join(f"arg_max({v}, (t, id)) FILTER (WHERE {v} IS NOT NULL) AS last_{v}, min({v}) AS min_{v}, max({v}) AS max_{v}, round(avg({v}), 4) AS avg_{v}" for v in ('spread', 'liquidity'))} FROM r GROUP BY 1, 2""")
def ohlc_known(spark: SparkSession, d: str) -> DataFrame:
    """Buckets of the known values; a bucket ends with the last known one of each, and nothing known is null."""
    rows = ticks(spark, d).select("key", "id", "t", F.expr(_MID).alias("mid"), F.expr(_SPREAD).alias("spread"), F.expr(_LIQUIDITY).alias("liquidity"))
    return buckets.ohlc_known(rows, 3600, "mid", ["spread", "liquidity"])
