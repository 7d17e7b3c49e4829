"""Watchlist rows under cohorts and shadow policies: one pass over the rows for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import policies as P
from ..functions import stats
from ..operators import asof
from .registry import TICKS, query, ticks

#: Hours after a row at which its follow-through is measured, named as minutes are elsewhere, and the lookback of its pre-move.
HORIZONS, LOOKBACK = {"5m": 5, "15m": 15, "30m": 30, "60m": 60}, 10
_HOUR = 60 * asof.MINUTE

# A tick stands for a watchlist row; what the tables lack is drawn from its ids, in SQL that both engines read alike.
_FACTS = {
    "price": "least(cents, 9999)",
    "gap": "CASE WHEN id % 17 <> 0 THEN (id * 37 + key * 11) % 1001 * 10 - least(cents, 9999) END",
    "market_type": "CASE key % 4 WHEN 0 THEN 'winner' WHEN 1 THEN 'total' WHEN 2 THEN 'spread' END",
    "signal_type": "CASE WHEN type = 'error' THEN 'price_move_threshold' ELSE type END",
    "series": f"CASE WHEN key % 12 = 2 THEN '{P.LEFT_OUT_SERIES}' ELSE concat('SERIES', key % 12) END",
    "game": "concat('GAME', key % 30)",
    "spread_cents": "CASE WHEN id % 13 <> 0 THEN id % 12 END",
    "liquidity_cents": "CASE WHEN id % 11 <> 0 THEN cents * (1 + id % 5) * 300 END",
    "persistence": "id % 4",
    "confidence": "CASE WHEN id % 19 <> 0 THEN id % 100 END",
    "phase_tag": "CASE id % 5 WHEN 0 THEN 'late_game' WHEN 1 THEN 'mid_game' WHEN 2 THEN 'early_game' WHEN 3 THEN 'other' END",
    "status": "CASE id % 7 WHEN 0 THEN 'invalid' WHEN 1 THEN 'no_gap' WHEN 2 THEN 'paper_candidate_later' ELSE 'watchlist' END",
}
_TICKER = "concat(series, '-', game, '-', key)"


def _closure(after: Column) -> Column:
    return F.when(F.col("gap") != 0, (after - F.col("price")) / F.col("gap"))


def watchlist(spark: SparkSession, d: str) -> DataFrame:
    """Ticks as watchlist rows: facts, buckets, the pre-move and its relation to the gap, and the closure of the gap at each horizon."""
    t = ticks(spark, d)
    rows = t.select("*", *[F.expr(e).alias(n) for n, e in _FACTS.items()])
    rows = asof.first_in_lookback(rows, "price", "first", LOOKBACK * _HOUR)
    rows = asof.last_within(rows.withColumn("move", F.col("price") - F.col("first")).drop("first"), ["price", "spread_cents", "liquidity_cents"], {f"after_{h}": n * _HOUR for h, n in HORIZONS.items()}, size=t.count())
    closures = [_closure(F.col(f"after_{h}.price")).alias(f"closure_{h}") for h in HORIZONS]
    return rows.select(
        "key", "id", "t", *[n for n in _FACTS if n not in ("game", "phase_tag")], F.expr(_TICKER).alias("ticker"), P.game_of(F.expr(_TICKER)).alias("game"), *closures,
        L.gap_relation(F.col("gap").cast("double"), F.col("move").cast("double")).alias("relation"), F.nullif("move", F.lit(0)).alias("pre_move"), P.game_phase(F.array("phase_tag")).alias("phase"),
        L.gap_bucket(F.abs(F.col("gap")) / 10000.0).alias("gap_bucket"), P.confidence_bucket(F.col("confidence") / 100.0).alias("confidence_bucket"),
        L.liquidity_bucket(F.col("liquidity_cents")).alias("liquidity_bucket"), L.spread_bucket(F.col("spread_cents")).alias("spread_bucket"),
        (F.col("after_60m.spread_cents") - F.col("spread_cents")).alias("spread_change"), (F.col("after_60m.liquidity_cents") - F.col("liquidity_cents")).alias("liquidity_change"),
        L.path_class(_closure(F.col("after_60m.price"))).alias("path"),
    )


def _sql() -> str:
    facts = ", ".join(f"{e} AS {n}" for n, e in _FACTS.items())
    after = lambda h, v: f"arg_max(CASE WHEN b.t <= a.t + {HORIZONS[h] * _HOUR} THEN {{'v': b.{v}}} END, CASE WHEN b.t <= a.t + {HORIZONS[h] * _HOUR} THEN (b.t, b.id) END).v"
    closures = ", ".join(f"CASE WHEN gap <> 0 THEN (after_{h} - price)::DOUBLE / gap END AS closure_{h}" for h in HORIZONS)
    return f"""WITH {TICKS}, r AS (SELECT *, {facts} FROM ticks),
b AS (SELECT a.id, {', '.join(f"{after(h, 'price')} AS after_{h}" for h in HORIZONS)}, {after('60m', 'spread_cents')} AS spread_60, {after('60m', 'liquidity_cents')} AS liquidity_60 FROM r a JOIN r b ON a.key = b.key AND b.t > a.t AND b.t <= a.t + {60 * _HOUR} GROUP BY 1),
m AS (SELECT a.id, a.price - arg_min(b.price, (b.t, b.id)) AS move FROM r a JOIN r b ON a.key = b.key AND b.t <= a.t AND b.t >= a.t - {LOOKBACK * _HOUR} GROUP BY 1, a.price),
c AS (SELECT r.*, {_TICKER} AS ticker, move, nullif(move, 0) AS pre_move, {closures}, spread_60 - spread_cents AS spread_change, liquidity_60 - liquidity_cents AS liquidity_change,
CASE WHEN gap IS NULL THEN 'unknown' WHEN move = 0 THEN 'no_pre_move' WHEN gap = 0 THEN 'no_gap' WHEN (gap > 0) <> (move > 0) THEN 'opposes_move' ELSE 'follows_move' END AS relation,
CASE phase_tag WHEN 'late_game' THEN 'late' WHEN 'mid_game' THEN 'mid' WHEN 'early_game' THEN 'early' ELSE 'unknown' END AS phase,
CASE WHEN gap IS NULL THEN 'none' WHEN abs(gap) < 500 THEN '<0.05' WHEN abs(gap) < 750 THEN '0.05-0.075' WHEN abs(gap) < 1000 THEN '0.075-0.10' WHEN abs(gap) < 1500 THEN '0.10-0.15' ELSE '>0.15' END AS gap_bucket,
CASE WHEN confidence IS NULL THEN 'unknown' WHEN confidence < 60 THEN '<0.60' WHEN confidence < 65 THEN '0.60' ELSE '0.65+' END AS confidence_bucket,
CASE WHEN liquidity_cents IS NULL THEN 'unknown' WHEN liquidity_cents < 100000 THEN '<100k' WHEN liquidity_cents < 1000000 THEN '100k-1M' WHEN liquidity_cents < 10000000 THEN '1M-10M' ELSE '>10M' END AS liquidity_bucket,
CASE WHEN spread_cents IS NULL THEN 'unknown' WHEN spread_cents <= 1 THEN '1' WHEN spread_cents <= 2 THEN '2' WHEN spread_cents <= 5 THEN '3-5' WHEN spread_cents <= 10 THEN '6-10' ELSE '>10' END AS spread_bucket
FROM r LEFT JOIN b USING (id) LEFT JOIN m USING (id)),
w AS (SELECT *, CASE WHEN closure_60m IS NULL THEN 'no_sample' WHEN closure_60m <= -0.25 THEN 'continued_away' WHEN closure_60m >= 0.25 THEN 'reverted_toward' ELSE 'flat' END AS path FROM c)"""


_WATCH = _sql()
_MEASURES = ", ".join(f"count(closure_{h}) AS samples_{h}, CAST(count(*) FILTER (WHERE closure_{h} > 0) AS BIGINT) AS toward_{h}, count(*) FILTER (WHERE closure_{h} > 0)::DOUBLE / nullif(count(closure_{h}), 0) AS rate_{h}, round(avg(closure_{h}), 4) AS mean_closure_{h}" for h in HORIZONS)


def measures() -> list[Column]:
    """Per horizon: samples, rows that moved toward the forecast, their share, and the mean closure."""
    out = []
    for h in HORIZONS:
        c = F.col(f"closure_{h}")
        out += [F.count(c).alias(f"samples_{h}"), stats.count_where(c > 0).alias(f"toward_{h}"), P.toward_rate(c).alias(f"rate_{h}"), P.mean(c).alias(f"mean_closure_{h}")]
    return out


def pooled() -> Column:
    """The toward rate over the samples of all horizons."""
    total = lambda name: sum((F.col(f"{name}_{h}") for h in HORIZONS), F.lit(0))
    return stats.rate(total("toward"), total("samples"))


_TOTAL = lambda name: "(" + " + ".join(f"{name}_{h}" for h in HORIZONS) + ")"
_POOLED = f"{_TOTAL('toward')}::DOUBLE / nullif({_TOTAL('samples')}, 0)"
_MOST = "greatest(" + ", ".join(f"samples_{h}" for h in HORIZONS) + ")"
_DIMENSIONS = ("market_type", "signal_type", "series", "game", "gap_bucket", "confidence_bucket", "liquidity_bucket", "spread_bucket", "phase", "relation", "persistence", "status", "path")
_FOLLOW_LABEL = "CASE WHEN most < 12 OR pooled_rate IS NULL THEN 'too_thin' WHEN pooled_rate >= 0.55 THEN 'promising' WHEN pooled_rate <= 0.35 THEN 'exclude' WHEN pooled_rate < 0.45 THEN 'weak' ELSE 'neutral' END"


@query(_WATCH + f""", x AS (SELECT unnest([{', '.join(f"{{'dim': '{n}', 'value': coalesce(CAST({n} AS VARCHAR), 'unknown')}}" for n in _DIMENSIONS)}, {{'dim': 'all', 'value': 'all'}}]) AS g, * FROM w),
s AS (SELECT g.dim AS dim, g.value AS value, count(*) AS n, CAST(count(*) FILTER (WHERE status = 'watchlist') AS BIGINT) AS watchlist, CAST(count(*) FILTER (WHERE status = 'invalid') AS BIGINT) AS invalid, round(avg(abs(gap)), 4) AS mean_abs_gap, round(avg(confidence), 4) AS mean_confidence, {_MEASURES} FROM x GROUP BY 1, 2),
p AS (SELECT *, {_POOLED} AS pooled_rate, {_MOST} AS most FROM s) SELECT * EXCLUDE (most), {_FOLLOW_LABEL} AS verdict FROM p""")
def cohort_followthrough(spark: SparkSession, d: str) -> DataFrame:
    """Each row counts in every dimension at once, at four horizons; grouped once, with partial sums before the shuffle."""
    dims = F.array(*[F.struct(F.lit(n).alias("dim"), F.coalesce(F.col(n).cast("string"), F.lit("unknown")).alias("value")) for n in _DIMENSIONS], F.struct(F.lit("all").alias("dim"), F.lit("all").alias("value")))
    closures = [f"closure_{h}" for h in HORIZONS]
    each = watchlist(spark, d).select(F.explode(dims).alias("g"), F.col("status").alias("_status"), F.abs("gap").alias("_gap"), F.col("confidence").alias("_confidence"), *closures).select("g.*", "_status", "_gap", "_confidence", *closures)
    out = each.groupBy("dim", "value").agg(
        F.count("*").alias("n"), stats.count_where(F.col("_status") == "watchlist").alias("watchlist"), stats.count_where(F.col("_status") == "invalid").alias("invalid"),
        P.mean(F.col("_gap")).alias("mean_abs_gap"), P.mean(F.col("_confidence")).alias("mean_confidence"), *measures(),
    )
    most = F.greatest(*[f"samples_{h}" for h in HORIZONS])
    return out.withColumn("pooled_rate", pooled()).withColumn("verdict", L.follow_label(most, F.col("pooled_rate")))


def _passing(policies: dict[str, str]) -> Column:
    return F.explode(L.reasons([(F.expr(c), n) for n, c in policies.items()])).alias("policy")


def _passing_sql(policies: dict[str, str]) -> str:
    return "unnest(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in policies.items()) + "], lambda z: z IS NOT NULL)) AS policy"


_SHARE = "max(k)::DOUBLE / nullif(sum(k), 0)"


@query(_WATCH + f""", worst AS (SELECT min((rate, series)) AS s FROM (SELECT series, count(*) FILTER (WHERE closure_60m > 0)::DOUBLE / count(closure_60m) AS rate FROM w GROUP BY 1 HAVING count(closure_60m) >= 10)),
v AS (SELECT w.*, worst.s[2] AS worst_series FROM w, worst), e AS (SELECT {_passing_sql(P.FILTERS)}, * FROM v),
s AS (SELECT policy, count(*) AS included, count(*)::DOUBLE / (SELECT count(*) FROM w) AS survival, {_MEASURES}, count(*) FILTER (WHERE path = 'continued_away')::DOUBLE / nullif(count(closure_60m), 0) AS away_rate, count(*) FILTER (WHERE path = 'reverted_toward')::DOUBLE / nullif(count(closure_60m), 0) AS reverted_rate, count(*) FILTER (WHERE path = 'flat')::DOUBLE / nullif(count(closure_60m), 0) AS flat_rate,
round(avg(spread_change), 4) AS mean_spread_change, round(avg(liquidity_change), 4) AS mean_liquidity_change FROM e GROUP BY 1),
tk AS (SELECT policy, {_SHARE} AS ticker_share FROM (SELECT policy, ticker, count(closure_60m) AS k FROM e GROUP BY 1, 2) GROUP BY 1), gm AS (SELECT policy, {_SHARE} AS game_share FROM (SELECT policy, game, count(closure_60m) AS k FROM e GROUP BY 1, 2) GROUP BY 1),
base AS (SELECT rate_60m AS base_60 FROM s WHERE policy = 'baseline_all_watchlist')
SELECT s.*, ticker_share, game_share, CASE WHEN samples_60m >= 30 AND ok THEN CASE WHEN coalesce(ticker_share, 0) <= 0.34 AND coalesce(game_share, 0) <= 0.5 THEN 'promising_shadow' ELSE 'neutral' END WHEN samples_60m < 30 AND (ok OR samples_60m < 12) THEN 'too_thin' WHEN survival < 0.1 THEN 'reject_policy' WHEN rate_60m < base_60 - 0.03 THEN 'worse_than_baseline' ELSE 'neutral' END AS label
FROM (SELECT *, coalesce(rate_30m, 0) >= 0.55 OR coalesce(rate_60m, 0) >= 0.55 OR coalesce(mean_closure_60m, 0) >= 0.1 AS ok FROM s) s JOIN tk USING (policy) JOIN gm USING (policy), base""".replace("SELECT s.*, ticker_share", "SELECT s.* EXCLUDE (ok), ticker_share"))
def shadow_policies(spark: SparkSession, d: str) -> DataFrame:
    """Eighteen filters on the same rows, with survival, follow-through, paths, concentration in one ticker or game, and a label.

    Rows are grouped once, by policy, series, ticker and game, to counts and sums, and that table is kept. All else comes from
    it: the worst series is the one with the lowest toward rate of ten samples or more, the first by name
    among equals, and its policy is the baseline without its groups.
    """
    worst_left_out = "exclude_worst_series"
    filters = {n: "true" if n == worst_left_out else c for n, c in P.FILTERS.items()}
    rows = watchlist(spark, d).select(_passing(filters), "series", "ticker", "game", "path", "spread_change", "liquidity_change", *[f"closure_{h}" for h in HORIZONS])
    sums = {"included": F.count("*")}
    for h in HORIZONS:
        c = F.col(f"closure_{h}")
        sums |= {f"samples_{h}": F.count(c), f"toward_{h}": stats.count_where(c > 0), f"closure_{h}": F.sum(c)}
    sums |= {p: stats.count_where(F.col("path") == p) for p in ("continued_away", "reverted_toward", "flat")}
    for c in ("spread_change", "liquidity_change"):
        sums |= {f"n_{c}": F.count(c), c: F.sum(c)}
    small = rows.groupBy("policy", "series", "ticker", "game").agg(*[c.alias(n) for n, c in sums.items()]).persist()  # read five times below; what is lost is made anew
    by_series = small.where("policy = 'baseline_all_watchlist'").groupBy("series").agg(F.sum("samples_60m").alias("n"), F.sum("toward_60m").alias("k")).where("n >= 10")
    worst = by_series.agg(F.min(F.struct(stats.rate(F.col("k"), F.col("n")).alias("rate"), "series")).alias("s")).select(F.col("s.series").alias("worst_series"))
    kept = small.join(F.broadcast(worst), how="left").where((F.col("policy") != worst_left_out) | F.expr(P.FILTERS[worst_left_out])).drop("worst_series")
    out = kept.groupBy("policy").agg(*[F.sum(n).alias(n) for n in sums])
    for by in ("ticker", "game"):
        each = kept.groupBy("policy", by).agg(F.sum("samples_60m").alias("k"))
        out = out.join(each.groupBy("policy").agg(stats.rate(F.max("k"), F.nullif(F.sum("k"), F.lit(0))).alias(f"{by}_share")), "policy")
    base = out.where("policy = 'baseline_all_watchlist'").select(stats.rate(F.col("toward_60m"), F.col("samples_60m")).alias("base_60"), F.col("included").alias("base_n"))
    mean = lambda total, n: F.round(stats.rate(F.col(total), F.col(n)), 4)
    final = F.col("samples_60m")
    out = out.join(F.broadcast(base)).select(
        "policy", "included", stats.rate(F.col("included"), F.col("base_n")).alias("survival"), "base_60", "ticker_share", "game_share",
        *[c for h in HORIZONS for c in (f"samples_{h}", f"toward_{h}", stats.rate(F.col(f"toward_{h}"), F.col(f"samples_{h}")).alias(f"rate_{h}"), mean(f"closure_{h}", f"samples_{h}").alias(f"mean_closure_{h}"))],
        *[stats.rate(F.col(p), final).alias(n) for p, n in (("continued_away", "away_rate"), ("reverted_toward", "reverted_rate"), ("flat", "flat_rate"))],
        *[mean(c, f"n_{c}").alias(f"mean_{c}") for c in ("spread_change", "liquidity_change")],
    )
    label = P.filter_label(final, F.col("rate_30m"), F.col("rate_60m"), F.col("mean_closure_60m"), F.col("base_60"), F.col("survival"), F.col("ticker_share"), F.col("game_share"))
    return out.withColumn("label", label).drop("base_60")


_SETTLED = "CASE WHEN id % 3 = 0 THEN id % 2 END"


@query(_WATCH + f""", e AS (SELECT {_passing_sql(P.COHORT_FILTERS)}, *, {_SETTLED} AS outcome FROM w),
s AS (SELECT policy, count(*) AS included, CAST(count(*) FILTER (WHERE status = 'watchlist') AS BIGINT) AS watchlist, CAST(count(*) FILTER (WHERE status = 'paper_candidate_later') AS BIGINT) AS paper_candidate_later, CAST(count(*) FILTER (WHERE status = 'invalid') AS BIGINT) AS invalid, CAST(count(*) FILTER (WHERE status = 'no_gap') AS BIGINT) AS no_gap, {_MEASURES},
CAST(count(*) FILTER (WHERE outcome IS NOT NULL AND gap IS NOT NULL) AS BIGINT) AS resolved, CAST(sum(CASE WHEN outcome IS NOT NULL THEN (price + gap - 10000 * outcome) * (price + gap - 10000 * outcome) - (price - 10000 * outcome) * (price - 10000 * outcome) END) FILTER (WHERE gap IS NOT NULL) AS DOUBLE) / 100000000 / nullif(count(*) FILTER (WHERE outcome IS NOT NULL AND gap IS NOT NULL), 0) AS forecast_minus_market_brier FROM e GROUP BY 1),
p AS (SELECT *, {_POOLED} AS pooled_rate, {_MOST} AS most FROM s)
SELECT * EXCLUDE (most), most AS follow_samples, resolved >= 12 AND coalesce(pooled_rate, 0) < 0.55 AND forecast_minus_market_brier < 0 AS settlement_disagrees FROM p""")
def cohort_policies(spark: SparkSession, d: str) -> DataFrame:
    """Thirteen filters by buckets, with statuses, follow-through, and whether settled outcomes favour the forecast where follow-through looks weak."""
    kept = watchlist(spark, d).withColumn("outcome", F.expr(_SETTLED)).select(_passing(P.COHORT_FILTERS), "status", "gap", "price", "outcome", *[f"closure_{h}" for h in HORIZONS])
    known = F.col("outcome").isNotNull() & F.col("gap").isNotNull()
    square = lambda x: (x - 10000 * F.col("outcome")) * (x - 10000 * F.col("outcome"))
    delta = F.when(known, square(F.col("price") + F.col("gap")) - square(F.col("price")))
    statuses = [stats.count_where(F.col("status") == s).alias(s) for s in ("watchlist", "paper_candidate_later", "invalid", "no_gap")]
    out = kept.groupBy("policy").agg(F.count("*").alias("included"), *statuses, *measures(), stats.count_where(known).alias("resolved"), F.sum(delta).alias("_delta"))
    out = out.withColumn("forecast_minus_market_brier", stats.rate(F.col("_delta").cast("double") / 1e8, F.col("resolved"))).drop("_delta").withColumn("pooled_rate", pooled()).withColumn("follow_samples", F.greatest(*[f"samples_{h}" for h in HORIZONS]))
    return out.withColumn("settlement_disagrees", (F.col("resolved") >= 12) & (F.coalesce("pooled_rate", F.lit(0.0)) < 0.55) & (F.col("forecast_minus_market_brier") < 0))
