"""Reports over cohorts: reliability by week, outcomes of shadow anchors, costs that could be had, and where a separation comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L
from ..functions import policies as P
from ..functions import scoring as S
from ..functions import stats
from ..operators import asof, ranking
from ..operators import calibration as C
from .forecasting import _BIN
from .policies import _FACTS, _HOUR, _WATCH, HORIZONS, watchlist
from .registry import TICKS, query, table, ticks

# Fixed values of the reports: samples and shifts that a reading needs.
LEAST_PERIOD, LEAST_PERIODS, ECE_TOLERANCE, SHARE_SHIFT, PREVALENCE_SHIFT = 15, 4, 0.02, 0.20, 0.15
LEAST_READABLE, LEAST_PROMISING, TOWARD_PROMISING, MOST_OF_TICKER, MOST_OF_GAME = 12, 75, 0.55, 0.34, 0.50


def dated_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """orders as forecasts: period (ISO week), domain (the customer's segment), p in thousandths and y."""
    o = table(spark, d, "orders").select("o_custkey", F.expr("extract(YEAROFWEEK FROM o_orderdate) * 100 + extract(WEEK FROM o_orderdate)").cast("int").alias("period"), F.pmod(F.round(F.col("o_totalprice") * 100).cast("long"), F.lit(1001)).alias("p"), (F.col("o_orderstatus") == "F").cast("long").alias("y"))
    return o.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.coalesce("c_mktsegment", F.lit("none")).alias("domain")), "o_custkey").drop("o_custkey")


def periods(forecasts: DataFrame) -> DataFrame:
    """Per period: scored, prevalence, brier, ece, top_share (of its largest domain) and label; thin periods are told, not dropped."""
    each = C.errors(C.bins(forecasts, ["period"]), ["period"]).select("period", F.col("n").alias("scored"), F.round("ece", 6).alias("ece"))
    error = F.col("p") - 1000 * F.col("y")
    domains = forecasts.groupBy("period", "domain").agg(F.count("*").alias("k"), F.sum("y").alias("yes"), F.sum(error * error).alias("squares"))
    rest = domains.groupBy("period").agg(F.round(F.sum("yes") / F.sum("k"), 6).alias("prevalence"), F.round(F.sum("squares") / F.lit(1e6) / F.sum("k"), 6).alias("brier"), F.round(F.max("k") / F.sum("k"), 6).alias("top_share"))
    return each.join(rest, "period").withColumn("label", F.when(F.col("scored") >= LEAST_PERIOD, "measured").otherwise("too_thin"))


_DATED = f"""forecasts AS (SELECT CAST(isoyear(o_orderdate) * 100 + week(o_orderdate) AS INT) AS period, CAST(round(o_totalprice * 100) AS BIGINT) % 1001 AS p, CAST(o_orderstatus = 'F' AS INT) AS y, coalesce(c_mktsegment, 'none') AS domain FROM orders JOIN customer ON c_custkey = o_custkey),
bn AS (SELECT period, {_BIN} AS bin, abs(sum(p) / 1000.0::DOUBLE - sum(y)) AS gap FROM forecasts GROUP BY 1, 2), ee AS (SELECT period, sum(gap) AS gap FROM bn GROUP BY 1), dm AS (SELECT period, domain, count(*) AS k FROM forecasts GROUP BY 1, 2), tp AS (SELECT period, max(k) AS most FROM dm GROUP BY 1),
w AS (SELECT period, count(*) AS scored, round(any_value(gap) / count(*), 6) AS ece, round(sum(y)::DOUBLE / count(*), 6) AS prevalence, round(sum((p - 1000 * y) * (p - 1000 * y)) / 1e6::DOUBLE / count(*), 6) AS brier, round(any_value(most)::DOUBLE / count(*), 6) AS top_share, CASE WHEN count(*) >= {LEAST_PERIOD} THEN 'measured' ELSE 'too_thin' END AS label FROM forecasts JOIN ee USING (period) JOIN tp USING (period) GROUP BY 1)"""


@query(f"WITH {_DATED} SELECT * FROM w")
def weekly_reliability(spark: SparkSession, d: str) -> DataFrame:
    """Calibration error, score, prevalence and the share of the largest domain in each ISO week."""
    return periods(dated_forecasts(spark, d))


@query(f"""WITH {_DATED}, m AS (SELECT *, row_number() OVER (ORDER BY period) <= count(*) OVER () // 2 AS early FROM w WHERE label = 'measured'),
h AS (SELECT count(*) AS measured_periods, {', '.join(f"round(avg({c}) FILTER (WHERE {'early' if e == 'early' else 'NOT early'}), 6) AS {e}_{c}" for c in ('ece', 'top_share', 'prevalence') for e in ('early', 'late'))} FROM m)
SELECT *, CASE WHEN measured_periods < {LEAST_PERIODS} THEN 'too_thin_for_trend' WHEN abs(late_top_share - early_top_share) >= {SHARE_SHIFT} OR abs(late_prevalence - early_prevalence) >= {PREVALENCE_SHIFT} THEN 'composition_shift_dominates' WHEN abs(late_ece - early_ece) < {ECE_TOLERANCE} THEN 'reliability_stable' WHEN late_ece < early_ece THEN 'reliability_improving' ELSE 'reliability_deteriorating' END AS label FROM h""")
def reliability_trend(spark: SparkSession, d: str) -> DataFrame:
    """Early weeks against late ones, thin weeks left out; where the mix has shifted, that is said instead. The window ranks weeks."""
    return trend(periods(dated_forecasts(spark, d)))


def trend(weeks: DataFrame) -> DataFrame:
    """One row: the means of the early and the late half of the measured periods, and the reading; without periods it is too thin."""
    ranked = weeks.where("label = 'measured'").withColumn("early", F.row_number().over(Window.orderBy("period")) <= F.floor(F.count("*").over(Window.partitionBy()) / 2))
    half = lambda c, early: F.round(F.avg(F.when(F.col("early") == early, F.col(c))), 6)
    out = ranked.agg(F.count("*").alias("measured_periods"), *[half(c, e == "early").alias(f"{e}_{c}") for c in ("ece", "top_share", "prevalence") for e in ("early", "late")])
    moved = lambda c, by: F.abs(F.col(f"late_{c}") - F.col(f"early_{c}")) >= by
    better = F.col("late_ece") < F.col("early_ece")
    label = L.first_reason(
        [(F.col("measured_periods") < LEAST_PERIODS, "too_thin_for_trend"), (moved("top_share", SHARE_SHIFT) | moved("prevalence", PREVALENCE_SHIFT), "composition_shift_dominates"), (~moved("ece", ECE_TOLERANCE), "reliability_stable"), (better, "reliability_improving")],
        "reliability_deteriorating",
    )
    return out.withColumn("label", label)


_SHADOW = {**{n: _FACTS[n] for n in ("price", "liquidity_cents", "market_type", "confidence")}, "volume": "cents * (1 + id % 3)", "score": "CASE WHEN id % 19 = 0 THEN 'unknown' WHEN id % 100 >= 70 THEN 'high' WHEN id % 100 >= 40 THEN 'mid' ELSE 'low' END"}
_CHANGED = ("price", "liquidity_cents", "volume")
_PPM = "CAST(round(({after} - {x}) * 1000000.0::DOUBLE / nullif({x}, 0)) AS BIGINT)"


@query(f"""WITH {TICKS}, r AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _SHADOW.items())} FROM ticks), hz AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {h * _HOUR})" for n, h in HORIZONS.items())}) v(horizon, w)),
x AS (SELECT a.id, horizon, {', '.join(f"arg_max({{'v': b.{c}}}, (b.t, b.id)).v AS after_{c}" for c in _CHANGED)} FROM r a CROSS JOIN hz JOIN r b ON b.key = a.key AND b.t > a.t AND b.t <= a.t + w GROUP BY 1, 2),
e AS (SELECT r.id, hz.horizon, unnest([{{'dim': 'type', 'value': type}}, {{'dim': 'market_type', 'value': coalesce(market_type, 'unknown')}}, {{'dim': 'score', 'value': score}}]) AS g, {', '.join(_PPM.format(after=f'after_{c}', x=c) + f' AS {c}' for c in _CHANGED)}, after_liquidity_cents IS NOT NULL AS lk, after_liquidity_cents > 0 AS alive FROM r CROSS JOIN hz LEFT JOIN x ON x.id = r.id AND x.horizon = hz.horizon)
SELECT g.dim AS dim, g.value AS value, horizon, count(*) AS n, count(price) AS known, {', '.join(f"round(avg({c}), 3) AS mean_{c}" for c in _CHANGED)}, median(price) AS median_price, round(count(*) FILTER (WHERE alive)::DOUBLE / nullif(count(*) FILTER (WHERE lk), 0), 6) AS survival, CASE WHEN count(*) >= {LEAST_READABLE} THEN 'measured' ELSE 'too_thin' END AS label FROM e GROUP BY 1, 2, 3""")
def shadow_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Per cohort and horizon the mean and median change of price, the mean changes of liquidity and volume in millionths, and the share that survived.

    Changes are whole numbers; medians come from value counts, so no cohort's values are gathered.
    """
    rows = ticks(spark, d).select("*", *[F.expr(e).alias(n) for n, e in _SHADOW.items()])
    found = asof.last_within(rows, list(_CHANGED), {f"after_{h}": n * _HOUR for h, n in HORIZONS.items()})
    dims = F.array(*[F.struct(F.lit(n).alias("dim"), F.coalesce(F.col(n), F.lit("unknown")).alias("value")) for n in ("type", "market_type", "score")])
    per = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"after_{h}").alias("after")) for h in HORIZONS])
    each = found.select(F.explode(per).alias("h"), dims.alias("dims"), *_CHANGED)
    each = each.select(F.explode("dims").alias("g"), F.col("h.horizon").alias("horizon"), *[F.round((F.col(f"h.after.{c}") - F.col(c)) * F.lit(1_000_000.0) / F.nullif(F.col(c), F.lit(0))).cast("long").alias(c) for c in _CHANGED], F.col("h.after.liquidity_cents").alias("left"))
    keys, each = ["dim", "value", "horizon"], each.select("g.*", "horizon", *_CHANGED, "left")
    by = each.groupBy(*keys).agg(F.count("*").alias("n"), F.count("price").alias("known"), *[F.round(F.avg(c), 3).alias(f"mean_{c}") for c in _CHANGED], F.round(stats.rate(stats.count_where(F.col("left") > 0), F.count("left")), 6).alias("survival"))
    known = F.col("known")
    middle = ranking.at_ranks(ranking.value_counts(each.select(*keys, "price"), keys, "price", 50_000), keys, "price", {"low": F.expr("(known + 1) div 2"), "high": F.expr("known div 2 + 1")})
    middle = middle.select(*keys, F.when(known > 0, (F.col("low") + F.col("high")) / 2).alias("median_price"))
    return by.join(middle, keys).withColumn("label", F.when(F.col("n") >= LEAST_READABLE, "measured").otherwise("too_thin"))


_FEE, _COST_DIMS = 0.07, ("series", "liquidity_bucket", "spread_bucket", "confidence_bucket")
_CLOSURES = ("frictionless", "after_spread", "after_fees", "touch")


def cost_label(n: Column, toward: Column, frictionless: Column, after_fees: Column, touch: Column, ticker_share: Column, game_share: Column) -> Column:
    """too_thin, promising_friction_adjusted_shadow (clears every bar, from no one ticker or game), cost_killed (only costs make it no gain), else neutral."""
    clears = (touch > 0) & (after_fees > 0) & (F.coalesce(toward, F.lit(0.0)) >= TOWARD_PROMISING) & (F.coalesce(ticker_share, F.lit(0.0)) <= MOST_OF_TICKER) & (F.coalesce(game_share, F.lit(0.0)) <= MOST_OF_GAME)
    killed = (frictionless > 0) & (F.coalesce(after_fees <= 0, F.lit(False)) | F.coalesce(touch <= 0, F.lit(False)))
    return L.first_reason([(n < LEAST_READABLE, "too_thin"), ((n >= LEAST_PROMISING) & F.coalesce(clears, F.lit(False)), "promising_friction_adjusted_shadow"), (F.coalesce(killed, F.lit(False)), "cost_killed")], "neutral")


@query(_WATCH + f""", cm AS (SELECT *, abs(gap)::DOUBLE AS size, closure_60m * abs(gap) AS toward, price / 10000.0::DOUBLE AS m0, (price + closure_60m * gap) / 10000.0::DOUBLE AS mh, spread_change + spread_cents AS spread_60 FROM w WHERE closure_60m IS NOT NULL),
k AS (SELECT *, closure_60m AS frictionless, (toward - 50 * spread_cents) / size AS after_spread, (toward - 50 * spread_cents - 10000 * ({_FEE}::DOUBLE * (m0 * (1 - m0) + mh * (1 - mh)))) / size AS after_fees, (toward - 50 * (spread_cents + spread_60)) / size AS touch FROM cm),
e AS (SELECT unnest([{{'dim': 'all', 'value': 'all'}}, {', '.join(f"{{'dim': '{n}', 'value': {n}}}" for n in _COST_DIMS)}]) AS g, * FROM k),
t AS (SELECT g, max(c) AS most FROM (SELECT g, ticker, count(*) AS c FROM e GROUP BY 1, 2) GROUP BY 1), q AS (SELECT g, max(c) AS most FROM (SELECT g, game, count(*) AS c FROM e GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT e.g, count(*) AS n, round(count(touch)::DOUBLE / count(*), 6) AS touch_coverage, round(count(*) FILTER (WHERE frictionless > 0)::DOUBLE / count(*), 6) AS toward_rate, {', '.join(f'round(avg({c}), 4) AS {c}' for c in _CLOSURES)}, round(any_value(t.most)::DOUBLE / count(*), 6) AS ticker_share, round(any_value(q.most)::DOUBLE / count(*), 6) AS game_share FROM e JOIN t ON t.g = e.g JOIN q ON q.g = e.g GROUP BY 1)
SELECT g.dim AS dim, g.value AS value, * EXCLUDE (g), CASE WHEN n < {LEAST_READABLE} THEN 'too_thin' WHEN n >= {LEAST_PROMISING} AND touch > 0 AND after_fees > 0 AND toward_rate >= {TOWARD_PROMISING} AND ticker_share <= {MOST_OF_TICKER} AND game_share <= {MOST_OF_GAME} THEN 'promising_friction_adjusted_shadow' WHEN frictionless > 0 AND (coalesce(after_fees <= 0, false) OR coalesce(touch <= 0, false)) THEN 'cost_killed' ELSE 'neutral' END AS label FROM s""")
def cost_cohorts(spark: SparkSession, d: str) -> DataFrame:
    """Closures by cohort before costs, after half the spread, after fees too, and between prices that could be had, with what each cohort's reading is.

    Rows are grouped once, by cohort, ticker and game; shares of one ticker or game come from that small table.
    """
    rows = watchlist(spark, d).where("closure_60m is not null")
    size, spread = F.abs("gap").cast("double"), F.col("spread_cents")
    move, m0, mh = F.col("closure_60m") * F.abs("gap"), F.col("price") / F.lit(10000.0), (F.col("price") + F.col("closure_60m") * F.col("gap")) / F.lit(10000.0)
    end = F.col("spread_change") + spread
    half = lambda s: 50 * s  # noqa: E731  of cents, in hundredths of a cent
    touch = S.touch_move(F.col("price") - half(spread), F.col("price") + half(spread), F.col("price") + F.col("closure_60m") * F.col("gap") - half(end), F.col("price") + F.col("closure_60m") * F.col("gap") + half(end), F.col("gap"))
    costs = {"frictionless": F.col("closure_60m"), "after_spread": (move - half(spread)) / size, "after_fees": (move - half(spread) - 10000 * S.round_trip_fee(m0, mh, _FEE)) / size, "touch": touch / size}
    dims = F.array(F.struct(F.lit("all").alias("dim"), F.lit("all").alias("value")), *[F.struct(F.lit(n).alias("dim"), F.col(n).alias("value")) for n in _COST_DIMS])
    each = rows.select(F.explode(dims).alias("g"), "ticker", "game", *[c.alias(n) for n, c in costs.items()]).select("g.*", "ticker", "game", *costs)
    small = each.groupBy("dim", "value", "ticker", "game").agg(F.count("*").alias("n"), stats.count_where(F.col("frictionless") > 0).alias("toward"), *[x for c in costs for x in (F.sum(c).alias(c), F.count(c).alias(f"n_{c}"))])
    keys = ["dim", "value"]
    out = small.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "toward", *costs, *[f"n_{c}" for c in costs])])
    for by in ("ticker", "game"):
        out = out.join(small.groupBy(*keys, by).agg(F.sum("n").alias("k")).groupBy(*keys).agg(F.max("k").alias(f"most_{by}")), keys)
    rate = lambda a, b: F.round(stats.rate(F.col(a), F.col(b)), 6)
    out = out.select(*keys, "n", rate("n_touch", "n").alias("touch_coverage"), rate("toward", "n").alias("toward_rate"), *[F.round(stats.rate(F.col(c), F.col(f"n_{c}")), 4).alias(c) for c in costs], rate("most_ticker", "n").alias("ticker_share"), rate("most_game", "n").alias("game_share"))
    return out.withColumn("label", cost_label(*[F.col(c) for c in ("n", "toward_rate", "frictionless", "after_fees", "touch", "ticker_share", "game_share")]))


_TAPED = "CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) % 2 = 0"
_STRATA = ("all", "taped", "derived")
_SPLIT = """CASE WHEN taped_delta IS NULL THEN CASE WHEN all_delta IS NOT NULL AND n_derived > n_taped THEN 'derived_only_dominates' ELSE 'tape_too_thin' END WHEN taped_label IN ('weak', 'strong') THEN CASE WHEN derived_label IN ('weak', 'strong') THEN 'consistent_across_sources' WHEN derived_delta IS NOT NULL THEN 'all_window_diluted' ELSE 'tape_only_hint' END WHEN derived_label IN ('weak', 'strong') THEN 'derived_only_dominates' ELSE 'tape_readable' END"""


def stratified_separation(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Per dimension the separation among all rows, among taped ones and among derived ones (``taped``, ``good``), where the signal lives, and whether all rows hide one that taped rows show.

    A cohort needs 12 rows, and 6 with a known outcome to have a rate. Counted once, by dimension, value and stratum; rows of unknown
    stratum are derived.
    """
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(x).alias("dim"), F.coalesce(F.col(x).cast("string"), F.lit("unknown")).alias("v")) for x in dims])).alias("g"), F.coalesce("taped", F.lit(False)).alias("taped"), "good").select("g.*", "taped", "good")
    counts = each.groupBy("dim", "v", "taped").agg(F.count("*").alias("n"), F.count("good").alias("known"), stats.count_where(F.col("good")).alias("yes"))
    strata = F.explode(F.array(F.lit("all"), F.when(F.col("taped"), "taped").otherwise("derived"))).alias("stratum")
    by = counts.select("dim", "v", strata, "n", "known", "yes").groupBy("dim", "stratum", "v").agg(*[F.sum(c).alias(c) for c in ("n", "known", "yes")])
    rate, wide = F.when(F.col("known") >= 6, F.col("yes") / F.col("known")), F.col("n") >= 12
    read = by.withColumn("rate", F.when(wide, rate)).groupBy("dim", "stratum").agg(
        F.sum("n").alias("n"), stats.count_where(wide).alias("cohorts"), F.when(F.count("rate") >= 2, F.max("rate") - F.min("rate")).alias("delta"), stats.rate(F.sum(F.when(wide, F.col("known"))), F.sum(F.when(wide, F.col("n")))).alias("share"),
    )
    label = L.first_reason([(F.col("cohorts") < 2, "too_thin"), ((F.col("share") < 0.3) | F.col("delta").isNull(), "provider_gap_dominates"), (F.col("delta") >= 0.25, "strong"), (F.col("delta") >= 0.10, "weak")], "none")
    read = read.withColumn("label", label).withColumn("delta", F.when(F.col("label").isin("strong", "weak", "none"), F.round("delta", 6)))
    pick = lambda s, c: F.max(F.when(F.col("stratum") == s, F.col(c)))
    out = read.groupBy("dim").agg(*[x for s in _STRATA for x in (F.coalesce(pick(s, "n"), F.lit(0)).alias(f"n_{s}"), F.coalesce(pick(s, "label"), F.lit("too_thin")).alias(f"{s}_label"), pick(s, "delta").alias(f"{s}_delta"))])
    signal = lambda s: F.col(f"{s}_label").isin("weak", "strong")
    return out.select("*", F.expr(_SPLIT).alias("source_label"), (signal("taped") & ~signal("all")).alias("diluted"))


@query(f"""WITH o AS (SELECT d.lang, CASE WHEN n_chars < 800 THEN 'short' WHEN n_chars < 2500 THEN 'middle' ELSE 'long' END AS size, {_TAPED} AS taped, l.quality = 1 AS good FROM documents d LEFT JOIN labels l USING (doc_id)),
c2 AS (SELECT g, s.stratum, good FROM (SELECT unnest([{{'dim': 'lang', 'v': coalesce(lang, 'unknown')}}, {{'dim': 'size', 'v': coalesce(size, 'unknown')}}]) AS g, coalesce(taped, false) AS taped, good FROM o) x, LATERAL (SELECT unnest(['all', CASE WHEN taped THEN 'taped' ELSE 'derived' END]) AS stratum) s),
b AS (SELECT g.dim AS dim, stratum, g.v AS v, count(*) AS n, count(good) AS known, CASE WHEN count(*) >= 12 AND count(good) >= 6 THEN count(*) FILTER (WHERE good)::DOUBLE / count(good) END AS rate FROM c2 GROUP BY 1, 2, 3),
r AS (SELECT dim, stratum, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (WHERE n >= 12) AS cohorts, CASE WHEN count(rate) >= 2 THEN max(rate) - min(rate) END AS delta, sum(known) FILTER (WHERE n >= 12)::DOUBLE / nullif(sum(n) FILTER (WHERE n >= 12), 0) AS share FROM b GROUP BY 1, 2),
l AS (SELECT dim, stratum, n, delta, CASE WHEN cohorts < 2 THEN 'too_thin' WHEN share < 0.3 OR delta IS NULL THEN 'provider_gap_dominates' WHEN delta >= 0.25 THEN 'strong' WHEN delta >= 0.10 THEN 'weak' ELSE 'none' END AS label FROM r),
p AS (SELECT dim, {', '.join(f"coalesce(max(n) FILTER (WHERE stratum = '{s}'), 0) AS n_{s}, coalesce(max(label) FILTER (WHERE stratum = '{s}'), 'too_thin') AS {s}_label, max(CASE WHEN label IN ('strong', 'weak', 'none') THEN round(delta, 6) END) FILTER (WHERE stratum = '{s}') AS {s}_delta" for s in _STRATA)} FROM l GROUP BY 1)
SELECT *, {_SPLIT} AS source_label, taped_label IN ('weak', 'strong') AND all_label NOT IN ('weak', 'strong') AS diluted FROM p""")
def source_stratification(spark: SparkSession, d: str) -> DataFrame:
    """The separation of outcomes by dimension, read apart for two kinds of sources, so that a mixed reading can't hide that only one kind shows it."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("n_chars") < 800, "short").when(F.col("n_chars") < 2500, "middle").otherwise("long").alias("size"), F.expr(_TAPED).alias("taped"))
    known = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    return stratified_separation(docs.join(known, "doc_id", "left"), ["lang", "size"])
