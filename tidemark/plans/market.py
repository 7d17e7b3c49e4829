"""Scans, buckets, as-of lookups and window measures over ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L
from ..functions import scoring as S
from ..functions import stats, text
from ..operators import asof, buckets, ranking, windows
from .registry import FORECASTS, TICKS, forecasts, query, table, ticks

HORIZONS = (5, 15, 30, 60)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1995-01-01' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def scan_top(spark: SparkSession, d: str) -> DataFrame:
    """A pruned and filtered scan, the largest first."""
    rows = table(spark, d, "orders").where("o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP_NTZ'1995-01-01 00:00:00'")
    return rows.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


def _ohlc_sql(seconds: int) -> str:
    us = seconds * 1_000_000
    return f"""WITH {TICKS} SELECT key, t - t % {us} AS bucket, arg_min(cents, (t, id)) AS open, max(cents) AS high, min(cents) AS low,
    arg_max(cents, (t, id)) AS close, sum(cents)::DOUBLE / count(*) AS mean, count(*) AS tick_count FROM ticks GROUP BY 1, 2"""


@query(_ohlc_sql(60))
def ohlc_60s(spark: SparkSession, d: str) -> DataFrame:
    """A5, R14."""
    return buckets.ohlc(ticks(spark, d), 60)


@query(_ohlc_sql(3600))
def ohlc_hour(spark: SparkSession, d: str) -> DataFrame:
    return buckets.ohlc(ticks(spark, d), 3600)


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """A4, W2."""
    return buckets.latest_per_key(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_totalprice", "o_orderstatus"])


@query(f"""WITH {TICKS}, raw AS (SELECT DISTINCT key, t - t % 3600000000 AS hour FROM ticks), had AS (SELECT DISTINCT key, t - t % 3600000000 AS hour FROM ticks WHERE cents > 1000)
SELECT key, count(*) AS raw_hours, count(had.hour) AS covered_hours, count(had.hour)::DOUBLE / count(*) AS coverage FROM raw LEFT JOIN had USING (key, hour) GROUP BY 1""")
def hour_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Hours with ticks against hours with buckets of ticks above a floor."""
    t = ticks(spark, d)
    return buckets.hour_coverage(t, buckets.ohlc(t.where("cents > 1000"), 3600))


@query(f"""WITH {TICKS}, b AS (SELECT key, t - t % 3600000000 AS bucket, type, count(*) AS n FROM ticks GROUP BY 1, 2, 3)
SELECT type, sum(n)::DOUBLE / count(*) AS ratio, CAST(sum(n) AS BIGINT) AS ticks, count(*) AS buckets FROM b GROUP BY 1""")
def compression_ratio(spark: SparkSession, d: str) -> DataFrame:
    """A7."""
    b = ticks(spark, d).groupBy("key", buckets.bucket_start(F.col("t"), 3600).alias("bucket"), "type").count()
    return b.groupBy("type").agg((F.sum("count") / F.count("*")).alias("ratio"), F.sum("count").alias("ticks"), F.count("*").alias("buckets"))


def _last_sql(minutes: int, name: str) -> str:
    return f"arg_max(CASE WHEN b.t <= a.t + {minutes * asof.MINUTE} THEN b.cents END, CASE WHEN b.t <= a.t + {minutes * asof.MINUTE} THEN (b.t, b.id) END) AS {name}"


_FOLLOW = f"""WITH {TICKS}, f AS (SELECT a.key, a.id, a.type, a.t, a.cents, {', '.join(_last_sql(m, f'after_{m}m') for m in HORIZONS)}
FROM ticks a LEFT JOIN ticks b ON a.key = b.key AND b.t > a.t AND b.t <= a.t + {60 * asof.MINUTE} GROUP BY 1, 2, 3, 4, 5)"""


def follow(spark: SparkSession, d: str) -> DataFrame:
    t = ticks(spark, d)
    found = asof.last_within(t, ["cents"], {f"after_{m}m": m * asof.MINUTE for m in HORIZONS})
    return found.select("key", "id", "type", "t", "cents", *[F.col(f"after_{m}m.cents").alias(f"after_{m}m") for m in HORIZONS])


@query(_FOLLOW + " SELECT key, id, after_5m, after_15m, after_30m, after_60m FROM f")
def followthrough_5_15_30_60(spark: SparkSession, d: str) -> DataFrame:
    """The last value within each horizon after the anchor."""
    return follow(spark, d).select("key", "id", *[f"after_{m}m" for m in HORIZONS])


_CLOSURE = "(CASE WHEN after_60m IS NOT NULL AND cents <> 5000 THEN (CASE WHEN 5000 > cents THEN after_60m - cents ELSE cents - after_60m END)::DOUBLE / abs(5000 - cents) END)"


def closures(spark: SparkSession, d: str) -> DataFrame:
    """Anchors with the part of their gap to 5,000 cents that the next hour closed."""
    gap = F.lit(5000) - F.col("cents")
    closure = F.when(F.col("after_60m").isNotNull() & (gap != 0), S.toward_move(F.col("cents"), F.col("after_60m"), gap) / F.abs(gap))
    return follow(spark, d).withColumn("closure", closure)


@query(_FOLLOW + f""", c AS (SELECT type, {_CLOSURE} AS closure FROM f)
SELECT type, count(*) AS n, count(closure) AS samples, CAST(count(*) FILTER (WHERE closure > 0) AS BIGINT) AS toward, count(*) FILTER (WHERE closure > 0)::DOUBLE / nullif(count(closure), 0) AS toward_rate,
CAST(count(*) FILTER (WHERE closure <= -0.25) AS BIGINT) AS away, CASE WHEN count(closure) < 12 THEN 'too_thin' WHEN count(*) FILTER (WHERE closure > 0)::DOUBLE / nullif(count(closure), 0) >= 0.55 THEN 'promising'
WHEN count(*) FILTER (WHERE closure > 0)::DOUBLE / nullif(count(closure), 0) <= 0.35 THEN 'exclude' WHEN count(*) FILTER (WHERE closure > 0)::DOUBLE / nullif(count(closure), 0) < 0.45 THEN 'weak' ELSE 'neutral' END AS verdict FROM c GROUP BY 1""")
def followthrough_summary(spark: SparkSession, d: str) -> DataFrame:
    """How anchors of each type follow through."""
    n, toward = F.count("closure"), stats.count_where(F.col("closure") > 0)
    return closures(spark, d).groupBy("type").agg(
        F.count("*").alias("n"), n.alias("samples"), toward.alias("toward"), stats.rate(toward, n).alias("toward_rate"),
        stats.count_where(F.col("closure") <= L.AWAY).alias("away"), L.follow_label(n, stats.rate(toward, n)).alias("verdict"),
    )


_PRE = f"""WITH {TICKS}, p AS (SELECT a.id, a.cents, (SELECT arg_min(b.cents, (b.t, b.id)) FROM ticks b WHERE b.key = a.key AND b.t <= a.t AND b.t >= a.t - {600 * asof.MINUTE}) AS first_cents FROM ticks a)"""


@query(_PRE + """ SELECT id, cents - first_cents AS pre_move, CASE WHEN cents - first_cents = 0 THEN 'no_pre_move' WHEN cents = 5000 THEN 'no_gap' WHEN (5000 - cents > 0) <> (cents - first_cents > 0) THEN 'opposes_move' ELSE 'follows_move' END AS relation FROM p""")
def pre_move(spark: SparkSession, d: str) -> DataFrame:
    """The move since the first tick of the lookback, and how the gap lies to it."""
    move = F.col("cents") - F.col("first_cents")
    return asof.first_in_lookback(ticks(spark, d), "cents", "first_cents", 600 * asof.MINUTE).select("id", move.alias("pre_move"), L.gap_relation((F.lit(5000) - F.col("cents")).cast("double"), move.cast("double")).alias("relation"))


@query(f"""WITH {TICKS}, a AS (SELECT * FROM ticks WHERE type = 'purchase'), b AS (SELECT * FROM ticks WHERE type = 'view'),
m AS (SELECT a.id, a.t, max((b.t, b.id, b.cents)) AS x FROM a LEFT JOIN b ON a.key = b.key AND b.t <= a.t GROUP BY 1, 2)
SELECT id, CASE WHEN t - x[1] <= {1440 * asof.MINUTE} THEN x[3] END AS asof_value, CASE WHEN t - x[1] <= {1440 * asof.MINUTE} THEN t - x[1] END AS asof_age FROM m""")
def asof_backward_max_age(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's last view of the day before it."""
    t = ticks(spark, d)
    return asof.asof_backward(t.where("type = 'purchase'"), t.where("type = 'view'"), "key", "t", "id", "cents", 1440 * asof.MINUTE).select("id", "asof_value", "asof_age")


_H, _TOL = 60 * asof.MINUTE, 240 * asof.MINUTE


@query(f"""WITH {TICKS}, a AS (SELECT * FROM ticks WHERE type = 'purchase'), b AS (SELECT key, t, arg_min(cents, id) AS cents FROM ticks WHERE type = 'view' GROUP BY 1, 2),
m AS (SELECT a.id, min((abs(b.t - a.t - {_H}), b.t, b.cents)) AS x FROM a LEFT JOIN b ON a.key = b.key AND abs(b.t - a.t - {_H}) <= {_TOL} GROUP BY 1)
SELECT id, x[3] AS near_value, x[1] AS near_distance FROM m""")
def nearest_with_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """The view nearest to an hour after each purchase."""
    t = ticks(spark, d)
    return asof.nearest(t.where("type = 'purchase'"), t.where("type = 'view'"), "key", "t", "id", "cents", _H, _TOL).select("id", "near_value", "near_distance")


@query(f"""WITH {TICKS}, a AS (SELECT * FROM ticks WHERE type = 'purchase'), b AS (SELECT DISTINCT key, t FROM ticks WHERE type = 'view'),
m AS (SELECT a.id, a.t + {_H} AS target, max(b.t) FILTER (WHERE b.t <= a.t + {_H}) AS lo, min(b.t) FILTER (WHERE b.t > a.t + {_H}) AS hi FROM a LEFT JOIN b ON a.key = b.key GROUP BY 1, 2),
c AS (SELECT CASE WHEN lo IS NULL AND hi IS NULL THEN 'never_observed' WHEN lo = target THEN 'exact' WHEN least(target - lo, hi - target) <= {_TOL} THEN CASE WHEN hi IS NULL OR target - lo <= hi - target THEN 'near_before' ELSE 'near_after' END WHEN lo IS NULL THEN 'starts_late' WHEN hi IS NULL THEN 'ends_early' ELSE 'gap' END AS cause, target - lo AS before, hi - target AS after FROM m)
SELECT cause, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share, CAST(max(before) AS BIGINT) AS longest_before, CAST(max(after) AS BIGINT) AS longest_after FROM c GROUP BY 1""")
def coverage_causes(spark: SparkSession, d: str) -> DataFrame:
    """Why a target an hour after each purchase is or isn't covered by a view near it: the histogram of causes, from the nearest view on either side."""
    t = ticks(spark, d)
    found = asof.asof_bracket(t.where("type = 'purchase'"), t.where("type = 'view'"), "key", "t", "id", "cents", _H)
    before, after = F.col("target") - F.col("before.t"), F.col("after.t") - F.col("target")
    rows = found.select(before.alias("before"), after.alias("after"))
    b, a = F.col("before"), F.col("after")
    near = F.least(b, a) <= _TOL
    cause = F.when(b.isNull() & a.isNull(), "never_observed").when(b == 0, "exact").when(near & (a.isNull() | (b <= a)), "near_before").when(near, "near_after").when(b.isNull(), "starts_late").when(a.isNull(), "ends_early").otherwise("gap")
    by = rows.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"), F.max("before").alias("longest_before"), F.max("after").alias("longest_after"))
    total = by.agg(F.sum("n").alias("total"))
    return by.join(F.broadcast(total)).select("cause", "n", (F.col("n") / F.col("total")).alias("share"), "longest_before", "longest_after")


@query(f"""WITH {TICKS}, a AS (SELECT * FROM ticks WHERE type = 'purchase'), b AS (SELECT key, t, arg_min(cents, id) AS cents FROM ticks WHERE type = 'view' GROUP BY 1, 2),
l AS (SELECT a.id, a.t + {_H} AS target, max(CASE WHEN b.t <= a.t + {_H} THEN (b.t, b.cents) END) AS lo, min(CASE WHEN b.t > a.t + {_H} THEN (b.t, b.cents) END) AS hi FROM a LEFT JOIN b ON a.key = b.key GROUP BY 1, 2)
SELECT id, CASE WHEN lo[1] = target THEN lo[2]::DOUBLE WHEN hi[1] - lo[1] <= {2880 * asof.MINUTE} THEN lo[2] + (hi[2] - lo[2]) * ((target - lo[1])::DOUBLE / (hi[1] - lo[1])) END AS line_value,
CASE WHEN lo[1] = target THEN 'observed' WHEN hi[1] - lo[1] <= {2880 * asof.MINUTE} THEN 'interpolated' WHEN lo IS NULL OR hi IS NULL THEN 'one_sided' ELSE 'too_far_apart' END AS source FROM l""")
def interpolated_asof(spark: SparkSession, d: str) -> DataFrame:
    """The value on the line between the views around the target time."""
    t = ticks(spark, d)
    return asof.interpolated(t.where("type = 'purchase'"), t.where("type = 'view'"), "key", "t", "id", "cents", _H, 2880 * asof.MINUTE).select("id", "line_value", "source")


_SEMI = (("15m", 15, 600), ("1h", 60, 600), ("24h", 1440, 720))


@query(f"WITH {TICKS}, h AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a * asof.MINUTE}, {w * asof.MINUTE})" for n, a, w in _SEMI) + """) v(horizon, a, w)), p AS (SELECT DISTINCT key, t FROM ticks WHERE type = 'purchase')
SELECT p.key, p.t, horizon, EXISTS (SELECT 1 FROM ticks b WHERE b.key = p.key AND b.t > p.t AND b.t BETWEEN p.t + a - w AND p.t + a + w) AS observed FROM p, h""")
def interval_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Whether anything was observed around each horizon of a purchase."""
    t = ticks(spark, d)
    return asof.interval_semi(t.where("type = 'purchase'"), t, "key", "t", [(n, a * asof.MINUTE, w * asof.MINUTE) for n, a, w in _SEMI])


@query(f"""WITH {TICKS} SELECT id, lag(cents) OVER w AS prev_cents, cents - lag(cents) OVER w AS change, CASE WHEN lag(cents) OVER w <> 0 THEN (cents - lag(cents) OVER w)::DOUBLE / lag(cents) OVER w END AS growth FROM ticks WINDOW w AS (PARTITION BY key ORDER BY t, id)""")
def prior_row(spark: SparkSession, d: str) -> DataFrame:
    """Each tick against the one before it."""
    before = F.lag("cents").over(Window.partitionBy("key").orderBy("t", "id"))
    t = ticks(spark, d).withColumn("prev_cents", before)
    return t.select("id", "prev_cents", (F.col("cents") - F.col("prev_cents")).alias("change"), S.growth(F.col("cents"), F.col("prev_cents")).alias("growth"))


_DAY = 1440 * asof.MINUTE


@query(f"""WITH {TICKS}, m AS (SELECT id, count(*) OVER w AS n, arg_max(cents, (t, id)) OVER w - arg_min(cents, (t, id)) OVER w AS mv, max(cents) OVER w - min(cents) OVER w AS rg FROM ticks WINDOW w AS (PARTITION BY key ORDER BY t RANGE BETWEEN {_DAY} PRECEDING AND CURRENT ROW))
SELECT id, n, CASE WHEN n >= 2 THEN mv END AS move, CASE WHEN n >= 2 THEN rg END AS "range", CASE WHEN n >= 2 AND (abs(mv) >= 3000 OR rg >= 5000) THEN 'volatile' WHEN n < 2 THEN 'insufficient' ELSE 'calm' END AS state FROM m""")
def window_moves(spark: SparkSession, d: str) -> DataFrame:
    """Move and range of the trailing day, and what they say."""
    w = windows.trailing("cents", _DAY)
    t = ticks(spark, d).select("id", w["n"].alias("n"), w["move"].alias("move"), w["range"].alias("range"))
    return t.withColumn("state", L.volatility_state([(F.col("move"), 3000), (F.col("range"), 5000)], [F.col("move")]))


@query(f"""WITH {TICKS}, c AS (SELECT key, cents, lag(cents) OVER (PARTITION BY key ORDER BY t, id) AS prev FROM ticks) SELECT key, count(*) AS n, avg(CASE WHEN prev IS NOT NULL THEN (cents <> prev)::INT END) AS instability FROM c GROUP BY 1""")
def quote_instability(spark: SparkSession, d: str) -> DataFrame:
    """The share of neighbouring pairs that changed."""
    t = ticks(spark, d).withColumn("prev", F.lag("cents").over(Window.partitionBy("key").orderBy("t", "id")))
    return t.groupBy("key").agg(F.count("*").alias("n"), F.avg((F.col("cents") != F.col("prev")).cast("int")).alias("instability"))


@query(f"""WITH {TICKS}, s AS (SELECT *, CAST(sign(cents - 2000) AS INT) AS sg FROM ticks), b AS (SELECT *, sum(CASE WHEN coalesce(lag(sg) OVER w0 <> sg, true) OR sg = 0 THEN 1 ELSE 0 END) OVER w AS island FROM (SELECT *, lag(sg) OVER (PARTITION BY key ORDER BY t, id) AS pg FROM s) x WINDOW w AS (PARTITION BY key ORDER BY t, id))
SELECT id, CASE WHEN sg = 0 THEN 0 ELSE least(row_number() OVER (PARTITION BY key, island ORDER BY t, id), 21) END AS streak FROM b""".replace("coalesce(lag(sg) OVER w0 <> sg, true)", "coalesce(pg <> sg, true)"))
def streak_persistence(spark: SparkSession, d: str) -> DataFrame:
    """How long the sign against 2,000 cents has held, at most 21."""
    t = ticks(spark, d).withColumn("sg", F.signum(F.col("cents") - 2000).cast("int"))
    return windows.streak(t, "sg", 21).select("id", F.col("streak").cast("long").alias("streak"))


@query(f"""WITH {TICKS}, c AS (SELECT type, count(*) OVER (PARTITION BY type ORDER BY t RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS k FROM ticks) SELECT type, max(k) AS peak, count(*) AS n FROM c GROUP BY 1""")
def rolling_peak_1h(spark: SparkSession, d: str) -> DataFrame:
    """The most events of a type in any hour."""
    return windows.peak_rate(ticks(spark, d), ["type"], 3_600_000_000)


@query(f"""WITH {TICKS}, p AS (SELECT *, lag(cents) OVER (PARTITION BY key ORDER BY t, id) AS prev FROM ticks),
s AS (SELECT id, unnest([CASE WHEN abs(cents - prev) >= 4000 THEN 'move' END, CASE WHEN prev < 1000 AND cents >= 1000 THEN 'band_entry' END, CASE WHEN (cents - 2500) * (prev - 2500) < 0 THEN 'crossing' END, CASE WHEN prev IS NULL THEN 'new_key' END]) AS signal FROM p)
SELECT id, signal FROM s WHERE signal IS NOT NULL""")
def signal_detectors(spark: SparkSession, d: str) -> DataFrame:
    """Of W3 four detectors: what a tick sets off against the one before it; one row per signal."""
    t = ticks(spark, d).withColumn("prev", F.lag("cents").over(Window.partitionBy("key").orderBy("t", "id")))
    c, p = F.col("cents"), F.col("prev")
    found = L.reasons([(F.abs(c - p) >= 4000, "move"), ((p < 1000) & (c >= 1000), "band_entry"), ((c - 2500) * (p - 2500) < 0, "crossing"), (p.isNull(), "new_key")])
    return t.select("id", F.explode(found).alias("signal"))


@query(f"""WITH {TICKS}, {FORECASTS}, q AS (SELECT key, id, t, CASE WHEN type <> 'error' THEN cents END AS mid, CASE WHEN type <> 'error' THEN id * 7 % 13 END AS spread, coalesce(cents, 0) AS liquidity FROM ticks),
w AS (SELECT q.*, lag(id) OVER k AS before, lag(mid) OVER k AS was, lag(spread) OVER k AS was_spread, lag(liquidity) OVER k AS was_liquidity FROM q WINDOW k AS (PARTITION BY key ORDER BY t, id)),
f AS (SELECT w.*, forecasts.p * 5 AS p FROM w LEFT JOIN forecasts ON forecasts.id = w.key),
s AS (SELECT id, unnest([CASE WHEN abs(mid - was) >= 4000 THEN 'price_move' END, CASE WHEN was_spread > 5 AND spread <= 5 THEN 'spread_tightened' END, CASE WHEN before IS NOT NULL AND was IS NULL AND mid IS NOT NULL THEN 'newly_two_sided' END,
CASE WHEN was_liquidity < 1000 AND liquidity >= 1000 THEN 'liquidity_appeared' END, CASE WHEN (was - p) * (mid - p) < 0 THEN 'crossed_forecast' END]) AS signal FROM f)
SELECT id, signal FROM s WHERE signal IS NOT NULL""")
def watch_signals(spark: SparkSession, d: str) -> DataFrame:
    """What a quote sets off against the one before it: a move, a tighter spread, a second side, liquidity, a crossed forecast; one row per signal.

    The quote of an error has one side: no midpoint and no spread. A key's first quote sets off nothing.
    """
    two_sided = F.col("type") != "error"
    q = ticks(spark, d).select("key", "id", "t", F.when(two_sided, F.col("cents")).alias("mid"), F.when(two_sided, F.col("id") * 7 % 13).alias("spread"), F.coalesce("cents", F.lit(0)).alias("liquidity"))
    before = Window.partitionBy("key").orderBy("t", "id")
    q = q.withColumns({f"was_{c}": F.lag(c).over(before) for c in ("id", "mid", "spread", "liquidity")})
    q = q.join(forecasts(spark, d).select(F.col("id").alias("key"), (F.col("p") * 5).alias("p")), "key", "left")
    mid, was, p = F.col("mid"), F.col("was_mid"), F.col("p")
    found = L.reasons([
        (F.abs(mid - was) >= 4000, "price_move"),
        ((F.col("was_spread") > 5) & (F.col("spread") <= 5), "spread_tightened"),
        (F.col("was_id").isNotNull() & was.isNull() & mid.isNotNull(), "newly_two_sided"),
        ((F.col("was_liquidity") < 1000) & (F.col("liquidity") >= 1000), "liquidity_appeared"),
        ((was - p) * (mid - p) < 0, "crossed_forecast"),
    ])
    return q.select("id", F.explode(found).alias("signal"))


@query(f"""WITH RECURSIVE {TICKS}, r AS (SELECT *, row_number() OVER (PARTITION BY key, type ORDER BY t, id) AS k FROM ticks),
g AS (SELECT key, type, k, id, t, t AS last, true AS passes FROM r WHERE k = 1 UNION ALL SELECT r.key, r.type, r.k, r.id, r.t, CASE WHEN r.t - g.last >= 86400000000 THEN r.t ELSE g.last END, r.t - g.last >= 86400000000 FROM g JOIN r ON r.key = g.key AND r.type = g.type AND r.k = g.k + 1)
SELECT key, type, id, t FROM g WHERE passes""")
def cooldown(spark: SparkSession, d: str) -> DataFrame:
    """Events that come a day or more after the last one that passed, by user and type."""
    return windows.cooldown(ticks(spark, d).select("key", "type", "id", "t"), ["key", "type"], 86_400)


@query(f"""WITH {TICKS}, s AS (SELECT *, CAST(sum(coalesce((t - pt > 21600000000)::INT, 0)) OVER (PARTITION BY key ORDER BY t, id) AS BIGINT) AS session FROM (SELECT *, lag(t) OVER (PARTITION BY key ORDER BY t, id) AS pt FROM ticks) x)
SELECT key, session, min(t) AS start, max(t) AS "end", count(*) AS n, arg_min(cents, (t, id)) AS first_cents, arg_max(cents, (t, id)) AS last_cents FROM s GROUP BY 1, 2""")
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    """R16."""
    return windows.sessions(ticks(spark, d), 21_600_000_000)


_FEE = 0.07


@query(_FOLLOW + f""", c AS (SELECT type, least(cents, 9999) / 10000.0::DOUBLE AS m0, least(after_60m, 9999) / 10000.0::DOUBLE AS mh FROM f WHERE after_60m IS NOT NULL AND cents <> 5000),
k AS (SELECT type, CASE WHEN 0.5 > m0 THEN mh - m0 ELSE m0 - mh END AS move, {_FEE}::DOUBLE * (m0 * (1 - m0) + mh * (1 - mh)) AS fee FROM c)
SELECT type, count(*) AS n, CAST(count(*) FILTER (WHERE move > 0) AS BIGINT) AS toward, CAST(count(*) FILTER (WHERE move - 0.01 > 0) AS BIGINT) AS toward_after_spread, CAST(count(*) FILTER (WHERE move - 0.01 - fee > 0) AS BIGINT) AS toward_after_costs FROM k GROUP BY 1""")
def cost_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """Of A30 the counts of toward moves before and after half the spread and fees; cost_cohorts has closures, touch prices and labels."""
    price = lambda c: F.least(F.col(c), F.lit(9999)) / F.lit(10000.0)
    rows = follow(spark, d).where("after_60m IS NOT NULL AND cents <> 5000").select("type", price("cents").alias("m0"), price("after_60m").alias("mh"))
    move = S.toward_move(F.col("m0"), F.col("mh"), F.lit(0.5) - F.col("m0"))
    rows = rows.select("type", move.alias("move"), S.round_trip_fee(F.col("m0"), F.col("mh"), _FEE).alias("fee"))
    each = {"toward": F.col("move") > 0, "toward_after_spread": F.col("move") - 0.01 > 0, "toward_after_costs": F.col("move") - 0.01 - F.col("fee") > 0}
    return rows.groupBy("type").agg(F.count("*").alias("n"), *[stats.count_where(c).alias(k) for k, c in each.items()])


@query(_FOLLOW + f""", c AS (SELECT key, {_CLOSURE} AS closure FROM f), k AS (SELECT key, count(closure) AS n, count(*) FILTER (WHERE closure > 0)::DOUBLE / nullif(count(closure), 0) AS rate FROM c GROUP BY 1)
SELECT key, n, rate FROM k WHERE n >= 3 ORDER BY rate, key LIMIT 10""")
def worst_series(spark: SparkSession, d: str) -> DataFrame:
    """The keys with the lowest toward rate among those with samples enough."""
    n = F.count("closure")
    by = closures(spark, d).groupBy("key").agg(n.alias("n"), stats.rate(stats.count_where(F.col("closure") > 0), n).alias("rate"))
    return by.where("n >= 3").orderBy("rate", "key").limit(10)


@query(f"""WITH {TICKS}, w AS (SELECT key, list_sort(list(cents)) AS v, count(*) AS n, median(cents) AS median, CASE WHEN count(*) >= 3 THEN quantile_disc(cents, 0.9) END AS nearest_rank FROM ticks GROUP BY 1)
SELECT key, n, median, v[CAST(round_even(0.9 * (n - 1), 0) AS BIGINT) + 1] AS rounded_rank, nearest_rank FROM w""")
def percentile_families(spark: SparkSession, d: str) -> DataFrame:
    """Three definitions of a percentile, kept apart, from counts of values; no key's values are gathered."""
    known = F.col("known")
    ranks = {"low": F.expr("(known + 1) div 2"), "high": F.expr("known div 2 + 1"), "rounded_rank": ranking.rounded_rank(known, 0.9), "nearest_rank": ranking.nearest_rank(known, 0.9, 3)}
    by = ranking.at_ranks(ranking.value_counts(ticks(spark, d), ["key"], "cents", 1000), ["key"], "cents", ranks)
    return by.select("key", "n", ((F.col("low") + F.col("high")) / 2).alias("median"), "rounded_rank", "nearest_rank")


@query(f"""WITH {TICKS}, h AS (SELECT type, t - lag(t) OVER (PARTITION BY key ORDER BY id) AS hop FROM ticks) SELECT type, count(*) AS n, CAST(count(*) FILTER (WHERE hop IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (WHERE hop < 0) AS BIGINT) AS negative, CASE WHEN count(hop) >= 20 THEN quantile_disc(hop, 0.5) END AS p50_us, CASE WHEN count(hop) >= 100 THEN quantile_disc(hop, 0.99) END AS p99_us FROM h GROUP BY 1""")
def latency_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Hops between a user's events in order of id; negative ones are counted, not dropped, and percentiles come from counts of hops by minute."""
    hop, n, known = F.col("t") - F.lag("t").over(Window.partitionBy("key").orderBy("id")), F.col("n"), F.col("known")
    ranks = {"p50_us": ranking.nearest_rank(known, 0.5, 20), "p99_us": ranking.nearest_rank(known, 0.99, 100)}
    also = {"missing": F.coalesce(F.sum(F.when(F.col("hop").isNull(), n)), F.lit(0)), "negative": F.coalesce(F.sum(F.when(F.col("hop") < 0, n)), F.lit(0))}
    counts = ranking.value_counts(ticks(spark, d).select("type", hop.alias("hop")), ["type"], "hop", asof.MINUTE)
    return ranking.at_ranks(counts, ["type"], "hop", ranks, also).drop("known")


_SCORES = """s AS (SELECT p_partkey, p_brand, p_size, CAST(count(l_orderkey) AS BIGINT) AS lines, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS quantity FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_size").join(lines, "p_partkey", "left").select("p_partkey", "p_brand", "p_size", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("quantity", F.lit(0)).alias("quantity"))


@query(f"""WITH {_SCORES}, c AS (SELECT p_partkey, greatest(0, 1 - p_size / 100.0::DOUBLE) AS spread, CASE WHEN quantity > 0 THEN least(1.0::DOUBLE, ln(1 + quantity) / ln(1 + 1000000)) ELSE 0 END AS liquidity, CASE WHEN lines > 0 THEN least(1.0::DOUBLE, ln(1 + lines) / ln(1 + 100000)) ELSE 0 END AS volume,
CASE WHEN p_size <= 0.25 OR p_size >= 180 THEN 0 WHEN p_size < 1 THEN (p_size - 0.25) / 0.75 WHEN p_size <= 30 THEN 1 ELSE (180 - p_size) / 150.0::DOUBLE END AS expiration FROM s),
t AS (SELECT p_partkey, round(spread * 0.3 + liquidity * 0.25 + volume * 0.2 + expiration * 0.15 + 0.5 * 0.1, 9) AS score FROM c)
SELECT p_partkey, CAST(row_number() OVER (ORDER BY score DESC, p_partkey) AS INT) AS place FROM t QUALIFY place <= 100""")
def weighted_rank(spark: SparkSession, d: str) -> DataFrame:
    """Parts by weighted score, ties by key; the first hundred by a top-k."""
    days = F.col("p_size").cast("double")
    parts = {"spread": S.spread_score(F.col("p_size")), "liquidity": S.log_score(F.col("quantity"), S.LIQUIDITY_CEILING), "volume": S.log_score(F.col("lines"), S.VOLUME_CEILING), "expiration": S.trapezoid(days), "clarity": F.lit(0.5)}
    scored = _parts(spark, d).select("p_partkey", F.round(S.weighted_composite(parts), 9).alias("score"))
    top = scored.orderBy(F.desc("score"), "p_partkey").limit(100)
    return top.select("p_partkey", F.row_number().over(Window.orderBy(F.desc("score"), "p_partkey")).alias("place"))


@query(f"""WITH {_SCORES}, r AS (SELECT p_partkey, list_filter([CASE WHEN p_size > 40 THEN 'spread_too_wide' END, CASE WHEN quantity < 700 THEN 'liquidity_below_min' END, CASE WHEN lines < 25 THEN 'volume_below_min' END, CASE WHEN p_size < 2 THEN 'expires_too_soon' END], lambda x: x IS NOT NULL) AS why FROM s)
SELECT p_partkey, len(why) = 0 AS eligible, array_to_string(why, ',') AS reasons, coalesce(why[1], 'ok') AS status FROM r""")
def eligibility_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Every reason in order; the first one is the status."""
    why = L.reasons([(F.col("p_size") > 40, "spread_too_wide"), (F.col("quantity") < 700, "liquidity_below_min"), (F.col("lines") < 25, "volume_below_min"), (F.col("p_size") < 2, "expires_too_soon")])
    return _parts(spark, d).withColumn("why", why).select("p_partkey", (F.size("why") == 0).alias("eligible"), F.array_join("why", ",").alias("reasons"), F.coalesce(F.get("why", 0), F.lit("ok")).alias("status"))


@query(f"""WITH {_SCORES}, b AS (SELECT p_brand, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(lines) AS BIGINT) AS lines FROM s GROUP BY 1)
SELECT p_brand, n, quantity, n::DOUBLE / max(n) OVER () AS supply, quantity::DOUBLE / max(quantity) OVER () AS liquidity FROM b""")
def domain_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Each brand against the largest of the run."""
    b = _parts(spark, d).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))
    most = b.agg(F.max("n").alias("max_n"), F.max("quantity").alias("max_quantity"))
    return b.join(F.broadcast(most)).select("p_brand", "n", "quantity", (F.col("n") / F.col("max_n")).alias("supply"), (F.col("quantity") / F.col("max_quantity")).alias("liquidity"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice IS NULL THEN 'unknown' WHEN p_retailprice < 1000 THEN '<1k' WHEN p_retailprice < 1500 THEN '1k-1.5k' ELSE '>1.5k' END AS price_bucket, CASE WHEN p_size <= 1 THEN '1' WHEN p_size <= 2 THEN '2' WHEN p_size <= 5 THEN '3-5' WHEN p_size <= 10 THEN '6-10' ELSE '>10' END AS size_bucket, CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'one' WHEN starts_with(p_brand, 'Brand#2') THEN 'two' ELSE 'other' END AS domain, split_part(p_brand, '#', 1) AS series FROM part""")
def bucketizers(spark: SparkSession, d: str) -> DataFrame:
    """Of P10 to P12 the ladder with an unknown bucket, a domain by prefix and a series by split; the ladders themselves are in market_domains and cohort_followthrough."""
    return table(spark, d, "part").select(
        "p_partkey", L.ladder(F.col("p_retailprice"), [(1000, "<1k"), (1500, "1k-1.5k")], ">1.5k").alias("price_bucket"), L.spread_bucket(F.col("p_size")).alias("size_bucket"),
        text.by_prefix(F.col("p_brand"), [("Brand#1", "one"), ("Brand#2", "two")], "other").alias("domain"), F.split("p_brand", "#")[0].alias("series"),
    )
