"""Tokens, their pairs and planned observations; links to fixtures; gates of policies by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import gates as G
from ..functions import stats
from ..functions import tokens as T
from ..operators import asof, linkage, windows
from .market import _CLOSURE, _FOLLOW, closures
from .registry import TICKS, query, table, ticks

# What the tables lack is drawn from ids, in SQL that both engines read alike.
_TICK = {
    "liquidity": "CASE WHEN id % 11 <> 0 THEN cents * 2 END",
    "volume": "CASE WHEN id % 7 <> 0 THEN cents * (1 + id % 5) END",
    "change": "id % 23 - 5",
    "boosts": "CASE WHEN id % 9 < 2 THEN id % 9 * 2 END",
    "created": "CASE WHEN key % 13 <> 0 THEN t - key % 40 * 3600000000 END",
}
_RISK = {
    "level": "CASE id % 16 WHEN 1 THEN 'high' WHEN 2 THEN 'critical' WHEN 3 THEN 'severe' WHEN 4 THEN 'low' END",
    "flag": "CASE id % 41 WHEN 0 THEN 'honeypot' WHEN 1 THEN 'rug_risk' WHEN 2 THEN 'holder_risk' WHEN 3 THEN 'mint_authority_enabled' WHEN 4 THEN 'freeze_authority_enabled' WHEN 5 THEN 'suspicious_supply_control' END",
    "category": "CASE id % 37 WHEN 1 THEN 'provider_rug_flag' WHEN 2 THEN 'high_holder_concentration' WHEN 3 THEN 'mint_authority_enabled' END",
    "top10": "CASE WHEN id % 5 <> 0 THEN id % 100 END",
}
_ASSESSED = "id % 17 <> 0"


@query(f"""WITH {TICKS}, f AS (SELECT *, {_ASSESSED} AS assessed, {', '.join(f'{e} AS {n}' for n, e in (_TICK | _RISK).items())} FROM ticks),
w AS (SELECT *, lag(id) OVER k IS NULL AS first, lag(liquidity) OVER k AS was_liquidity, lag(volume) OVER k AS was_volume, coalesce(lag(boosts) OVER k, 0) AS was_boosts FROM f WINDOW k AS (PARTITION BY key ORDER BY t, id)),
s AS (SELECT id, unnest([CASE WHEN first AND t - created <= 86400000000 THEN 'new_pair' END, CASE WHEN NOT first AND liquidity >= 5000 AND coalesce(was_liquidity, 0) < 5000 THEN 'liquidity_appeared' END,
CASE WHEN was_liquidity >= 5000 AND liquidity * 2 < was_liquidity THEN 'liquidity_removed' END, CASE WHEN volume >= 1000 AND was_volume > 0 AND volume >= 3 * was_volume THEN 'volume_spike' END,
CASE WHEN change >= 15 THEN 'price_momentum' END, CASE WHEN coalesce(boosts, 0) > 0 AND was_boosts = 0 THEN 'boost_detected' END,
CASE WHEN assessed AND (level IN ('high', 'critical', 'severe') OR flag IN ('honeypot', 'rug_risk') OR category = 'provider_rug_flag') THEN 'rug_risk' END,
CASE WHEN assessed AND (flag = 'holder_risk' OR top10 >= 50 OR category = 'high_holder_concentration') THEN 'holder_risk' END,
CASE WHEN assessed AND (flag IN ('mint_authority_enabled', 'freeze_authority_enabled', 'suspicious_supply_control') OR category = 'mint_authority_enabled') THEN 'suspicious_supply_control' END]) AS signal FROM w)
SELECT id, signal FROM s WHERE signal IS NOT NULL""")
def token_signals(spark: SparkSession, d: str) -> DataFrame:
    """The nine signals of a token's tick against the one before it, one row per signal; without an assessment there is no risk signal."""
    one = lambda e: F.array_compact(F.array(F.expr(e)))
    risk = F.when(F.expr(_ASSESSED), F.struct(F.expr(_RISK["level"]).alias("level"), one(_RISK["flag"]).alias("flags"), one(_RISK["category"]).alias("categories"), F.expr(_RISK["top10"]).alias("top10")))
    rows = ticks(spark, d).select("key", "id", "t", F.struct("t", *[F.expr(e).alias(n) for n, e in _TICK.items()], risk.alias("risk")).alias("now"))
    before = Window.partitionBy("key").orderBy("t", "id")
    measures = F.struct(*[F.col("now")[n].alias(n) for n in ("liquidity", "volume", "boosts")])
    rows = rows.withColumn("was", F.lag(measures).over(before))
    return rows.select("id", F.explode(T.signals(F.col("was").isNull(), F.col("now"), F.col("was"))).alias("signal"))


_WIDTHS = "h AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {w})" for n, w in T.HORIZONS.items()) + ") v(horizon, w))"


@query(f"""WITH {TICKS}, {_WIDTHS}, m AS (SELECT key, CASE WHEN key % 17 <> 0 THEN min(t) END AS anchor FROM ticks GROUP BY 1), e AS (SELECT max(anchor) + 21600000000 AS now FROM m)
SELECT key, horizon, anchor + w AS target, abs(now - anchor - w) AS distance, CASE WHEN (key + w // 60000000) % 5 = 0 THEN 'already_observed' WHEN key % 6 = 0 THEN 'inactive' WHEN anchor IS NULL OR now < anchor + w - w // 2 THEN 'not_due' WHEN now <= anchor + w + w // 2 THEN 'due_now' ELSE 'overdue_unobserved' END AS state FROM m, h, e""")
def horizon_plans(spark: SparkSession, d: str) -> DataFrame:
    """What each member's observation at each horizon asks for six hours after the last birth."""
    m = ticks(spark, d).groupBy("key").agg(F.min("t").alias("born")).select("key", F.when(F.col("key") % 17 != 0, F.col("born")).alias("anchor"))
    now = m.agg((F.max("anchor") + 21_600 * T.SECOND).alias("now"))
    widths = F.array(*[F.struct(F.lit(n).alias("horizon"), F.lit(w).cast("long").alias("w")) for n, w in T.HORIZONS.items()])
    rows = m.join(F.broadcast(now)).select("key", "anchor", "now", F.inline(widths))
    target, half = F.col("anchor") + F.col("w"), F.expr("w div 2")
    state = T.plan_state(F.expr("(key + w div 60000000) % 5 = 0"), F.col("key") % 6 == 0, target - half, target + half, F.col("now"))
    return rows.select("key", "horizon", target.alias("target"), F.abs(F.col("now") - target).alias("distance"), state.alias("state"))


_ANCHOR = "min(t) - min(t) % 86400000000 + key % 40 * 60000000"
_G, _M = T.GRACE, 60 * T.SECOND


@query(f"""WITH {TICKS}, {_WIDTHS}, m AS (SELECT key, key // 3 AS g, {_ANCHOR} AS anchor FROM ticks GROUP BY key), s AS (SELECT g, horizon, count(*) AS members, max(anchor + w - w // 2) AS lo, min(anchor + w + w // 2) AS hi FROM m, h GROUP BY 1, 2),
p AS (SELECT g, max(members) AS members, CAST(count(*) FILTER (WHERE lo <= hi) AS BIGINT) AS shared, max(lo) FILTER (WHERE horizon = '15m') AS o, max(hi) FILTER (WHERE horizon = '15m') AS c FROM s GROUP BY 1), n AS (SELECT *, o + (g % 9 - 3) * 180000000 AS now FROM p)
SELECT g, members, shared, o AS earliest_arm, c - {_G} AS latest_arm, o + {_G} <= c AS grace_fits, o <= c AND now BETWEEN o AND c - {_G} AS arm_now, shared = 4 AND o + {_G} <= c AS eligible,
CASE WHEN o > c THEN 'no_overlapping_pair' WHEN now > c THEN 'expired' WHEN o + {_G} > c OR c - {_G} - {_M} < o OR now > c - {_G} - {_M} THEN 'insufficient_arm_slack' WHEN now < o - {_M} THEN 'pair_detected_not_due' WHEN now < o THEN 'pair_ready_for_manual_preparation' ELSE 'shared_due_now_ready' END AS state FROM n""")
def shared_windows(spark: SparkSession, d: str) -> DataFrame:
    """The stretch that the windows of a group's members share at each horizon, and how ready the shortest one is.

    A group's windows meet in the largest start and the smallest end, so no member meets another.
    """
    m = ticks(spark, d).groupBy("key").agg(F.min("t").alias("born")).select(F.expr("key div 3").alias("g"), F.expr("born - born % 86400000000 + key % 40 * 60000000").alias("anchor"))
    ends = {n: (F.max(F.col("anchor") + w - w // 2), F.min(F.col("anchor") + w + w // 2)) for n, w in T.HORIZONS.items()}
    by = m.groupBy("g").agg(F.count("*").alias("members"), *[x.alias(f"{s}_{n}") for n, pair in ends.items() for s, x in zip(("lo", "hi"), pair, strict=True)])
    shared = sum((F.col(f"lo_{n}") <= F.col(f"hi_{n}")).cast("long") for n in T.HORIZONS)
    by = by.select("g", "members", shared.alias("shared"), F.col("lo_15m").alias("o"), F.col("hi_15m").alias("c")).withColumn("now", F.expr("o + (g % 9 - 3) * 180000000"))
    o, c, now = F.col("o"), F.col("c"), F.col("now")
    fits = o + T.GRACE <= c
    return by.select(
        "g", "members", "shared", o.alias("earliest_arm"), (c - T.GRACE).alias("latest_arm"), fits.alias("grace_fits"), ((o <= c) & now.between(o, c - T.GRACE)).alias("arm_now"),
        ((F.col("shared") == len(T.HORIZONS)) & fits).alias("eligible"), T.readiness(o, c, now, _M).alias("state"),
    )


_W = T.HORIZONS["15m"]


@query(f"""WITH {TICKS}, m AS (SELECT key, key % 2 AS g, {_ANCHOR} + {_W} - {_W} // 2 AS o, {_ANCHOR} + {_W} - {_W} // 2 + (key % 23 - 6) * 60000000 AS p FROM ticks GROUP BY key), a AS (SELECT *, o + {_W} AS c, o + {_W} - {_G} - {_M} AS d, greatest(o - {_M}, p) AS k, p <= o + {_W} - {_G} - {_M} AS armed FROM m),
v AS (SELECT a.key, count(*) AS overlapping FROM a JOIN a b ON a.g = b.g AND a.key <> b.key AND b.o BETWEEN a.o - {_W} AND a.o + {_W} GROUP BY 1),
u AS (SELECT a.key, count(*) AS usable, arg_min(b.key, (b.k, b.key)) AS partner FROM a JOIN a b ON a.g = b.g AND (b.o, b.key) > (a.o, a.key) AND a.armed AND b.p <= a.d AND b.o + {_G} <= a.c GROUP BY 1),
r AS (SELECT a.*, coalesce(overlapping, 0) AS overlapping, coalesce(usable, 0) AS usable, partner, o + (key % 9 - 3) * 180000000 AS now FROM a LEFT JOIN v USING (key) LEFT JOIN u USING (key)), x AS (SELECT r.*, q.o AS po FROM r LEFT JOIN a q ON q.key = r.partner)
SELECT key, armed, overlapping, usable, partner, CASE WHEN po IS NULL THEN 'no_overlapping_pair' WHEN now > c THEN 'expired' WHEN po + {_G} > c OR c - {_G} - {_M} < po OR now > c - {_G} - {_M} THEN 'insufficient_arm_slack' WHEN now < po - {_M} THEN 'pair_detected_not_due' WHEN now < po THEN 'pair_ready_for_manual_preparation' ELSE 'shared_due_now_ready' END AS state FROM x""")
def pair_feasibility(spark: SparkSession, d: str) -> DataFrame:
    """How many tokens each one's window meets, with how many it could be used together, the one that is ready first, and how ready that pair is; counted by a sweep, no pair is made."""
    anchor = F.expr(f"born - born % 86400000000 + key % 40 * 60000000 + {_W} - {_W} div 2")
    m = ticks(spark, d).groupBy("key").agg(F.min("t").alias("born")).select(F.col("key").alias("id"), (F.col("key") % 2).alias("g"), anchor.alias("open"), (anchor + (F.col("key") % 23 - 6) * 60_000_000).alias("ready"))
    found = linkage.feasible_pairs(m, "g", _W, _G, _M)
    opens = m.select(F.col("id").alias("partner"), F.col("open").alias("shared"))
    now = F.col("open") + (F.col("id") % 9 - 3) * 180_000_000
    state = F.when(F.col("shared").isNull(), "no_overlapping_pair").otherwise(T.readiness(F.col("shared"), F.col("open") + _W, now, _M))
    return found.join(opens, "partner", "left").select(F.col("id").alias("key"), "armed", "overlapping", "usable", "partner", state.alias("state"))


_PAIR = {
    "price": "CASE WHEN pair % 13 <> 0 THEN cents END",
    "liquidity": "CASE WHEN pair % 7 <> 0 THEN quantity * 1000 ELSE 0 END",
    "txns": "quantity * (pair % 5)",
    "volume": "quantity * 100 * (pair % 3)",
    "exact": "pair % 2 = 0",
    "launchpad": "pair % 11 = 0",
}


@query(f"""WITH p AS (SELECT l_suppkey AS token, l_orderkey AS pair, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, max(l_shipdate) AS created FROM lineitem GROUP BY 1, 2),
f AS (SELECT token, pair, created, {', '.join(f'{e} AS {n}' for n, e in _PAIR.items())} FROM p), e AS (SELECT *, coalesce(price > 0 AND liquidity > 0, false) AS ok FROM f),
q AS (SELECT *, CASE WHEN ok THEN round(least(liquidity, 1000000) / 10000.0::DOUBLE + least(txns, 1000) * 0.2::DOUBLE + least(volume, 1000000) / 20000.0::DOUBLE + CASE WHEN exact THEN 25 ELSE 0 END - CASE WHEN txns > 0 OR volume > 0 THEN 0 ELSE 50 END, 4) END AS score FROM e)
SELECT token, count(*) AS pairs, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS eligible, min(pair) AS first_returned, arg_max(pair, (liquidity, -pair)) FILTER (WHERE ok) AS largest, arg_max(pair, (volume, -pair)) FILTER (WHERE ok) AS busiest,
arg_max(pair, (created, -pair)) FILTER (WHERE ok AND (txns > 0 OR volume > 0)) AS newest_active, arg_max(pair, (launchpad, liquidity, -pair)) FILTER (WHERE ok) AS launchpad_first, arg_max(pair, (score, -pair)) FILTER (WHERE ok) AS best, max(score) AS score FROM q GROUP BY 1""")
def pair_quality(spark: SparkSession, d: str) -> DataFrame:
    """The quality of a token's pairs, and the pair that each of six policies picks among those that can be observed; ties go to the smaller pair."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("token"), F.col("l_orderkey").alias("pair"))
    p = lines.agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.max(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.max("l_shipdate").alias("created"))
    f = p.select("token", "pair", "created", *[F.expr(e).alias(n) for n, e in _PAIR.items()])
    ok, active = T.eligible(F.col("price"), F.col("liquidity")), (F.col("txns") > 0) | (F.col("volume") > 0)
    f = f.withColumn("ok", ok).withColumn("score", T.pair_quality(F.col("price"), F.col("liquidity"), F.col("txns"), F.col("volume"), F.col("exact")))
    pick = lambda *by, where=F.lit(True): F.max_by("pair", F.when(F.col("ok") & where, F.struct(*by, -F.col("pair"))))
    return f.groupBy("token").agg(
        F.count("*").alias("pairs"), stats.count_where(F.col("ok")).alias("eligible"), F.min("pair").alias("first_returned"), pick("liquidity").alias("largest"), pick("volume").alias("busiest"),
        pick("created", where=active).alias("newest_active"), pick("launchpad", "liquidity").alias("launchpad_first"), pick("score").alias("best"), F.max("score").alias("score"),
    )


_DAY, _CODES = "CASE WHEN o_orderstatus <> 'P' THEN DATE '1995-01-01' + CAST(o_orderkey % 200 AS INT) END", "'P' || (o_custkey % 120) AS a, CASE WHEN o_orderkey % 17 <> 0 THEN 'Q' || (o_custkey % 50) END AS b"


@query(f"""WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority LIKE '5%' THEN 'total' ELSE 'match_winner' END AS kind, {_DAY} AS day, {_CODES} FROM orders WHERE o_orderkey % 3 = 0), f AS (SELECT o_orderkey AS id, {_DAY} AS day, {_CODES} FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 200 < 150),
e AS (SELECT m.id, rank, count(*) AS n, min(f.id) AS fixture FROM m, (VALUES (0, 0), (1, 1), (2, -1)) v(rank, off), f WHERE f.day = m.day + off AND f.a = m.a AND f.b = m.b GROUP BY 1, 2), x AS (SELECT id, arg_min(n, rank) AS n, arg_min(fixture, rank) AS fixture, min(rank) AS rank FROM e GROUP BY 1),
s AS (SELECT m.id, count(*) AS n, min(f.id) AS fixture FROM m JOIN f ON f.day = m.day AND f.b IS NOT NULL AND (f.a = m.a OR f.b = m.b) GROUP BY 1), k AS (SELECT DISTINCT m.id FROM m JOIN f ON abs(f.day - m.day) <= 1),
l AS (SELECT m.id, x.fixture AS both_, s.fixture AS one, CASE WHEN kind <> 'match_winner' THEN 'other_kind' WHEN day IS NULL THEN 'no_date' WHEN k.id IS NULL THEN 'day_not_fetched' WHEN b IS NULL THEN 'no_codes' WHEN x.n = 1 AND rank = 0 THEN 'codes_and_day' WHEN x.n = 1 THEN 'codes_and_adjacent_day' WHEN x.n > 1 THEN 'ambiguous' WHEN s.n = 1 THEN 'one_code' ELSE 'none' END AS basis
FROM m LEFT JOIN x USING (id) LEFT JOIN s USING (id) LEFT JOIN k USING (id))
SELECT id, CASE WHEN basis = 'other_kind' THEN 'incompatible_market_type' WHEN basis IN ('no_date', 'day_not_fetched', 'no_codes') THEN 'unresolved' WHEN basis LIKE 'codes%' THEN 'source_backed_link' WHEN basis IN ('ambiguous', 'one_code') THEN 'fuzzy_candidate' ELSE 'provider_no_match' END AS label, basis,
CASE WHEN basis LIKE 'codes%' OR basis = 'ambiguous' THEN both_ WHEN basis = 'one_code' THEN one END AS fixture FROM l""")
def fixture_links(spark: SparkSession, d: str) -> DataFrame:
    """Markets linked to fixtures by both codes and the day, else a day beside it, else by one code."""
    o = table(spark, d, "orders")
    number = lambda c, n: (F.col(c) % n).cast("string")
    day = F.when(F.col("o_orderstatus") != "P", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("o_orderkey") % 200).cast("int")))
    facts = [F.col("o_orderkey").alias("id"), day.alias("day"), F.concat(F.lit("P"), number("o_custkey", 120)).alias("a"), F.when(F.col("o_orderkey") % 17 != 0, F.concat(F.lit("Q"), number("o_custkey", 50))).alias("b")]
    kind = F.when(F.col("o_orderpriority").startswith("5"), "total").otherwise("match_winner")
    return linkage.link_fixtures(o.where("o_orderkey % 3 = 0").select(*facts, kind.alias("kind")), o.where("o_orderkey % 3 = 1 AND o_orderkey % 200 < 150").select(*facts))


_LONG = 1440 * asof.MINUTE
_DELTAS = {"spread": "CASE WHEN id % 4 <> 0 THEN id % 12 END", "liquidity": "CASE WHEN id % 5 <> 0 THEN cents * 7 END"}


@query(f"""WITH {TICKS}, r AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _DELTAS.items())} FROM ticks)
SELECT id, {', '.join(f"CASE WHEN count({n}) OVER w >= 2 THEN arg_max({n}, (t, id)) FILTER (WHERE {n} IS NOT NULL) OVER w - arg_min({n}, (t, id)) FILTER (WHERE {n} IS NOT NULL) OVER w END AS {n}_delta" for n in _DELTAS)} FROM r WINDOW w AS (PARTITION BY key ORDER BY t RANGE BETWEEN {_LONG} PRECEDING AND CURRENT ROW)""")
def window_deltas(spark: SparkSession, d: str) -> DataFrame:
    """How spread and liquidity changed over the trailing day, between known values only; null with fewer than two."""
    rows = ticks(spark, d).select("key", "id", "t", *[F.expr(e).alias(n) for n, e in _DELTAS.items()])
    return rows.select("id", *[windows.trailing(n, _LONG)["move"].alias(f"{n}_delta") for n in _DELTAS])


_ROLE = "CASE type WHEN 'view' THEN 'baseline' WHEN 'error' THEN 'negative_control' ELSE 'candidate' END"
_QUANT = "n >= 75 AND coalesce(toward >= 0.55, false) AND coalesce(closure > 0, false)"
_ADVERSE = "(coalesce(toward < 0.5, false) OR coalesce(closure < 0, false))"


@query(_FOLLOW + f""", c AS (SELECT type, key, t, {_CLOSURE} AS closure, (min(t) OVER () + max(t) OVER ()) // 2 AS lock FROM f), x AS (SELECT *, unnest(['all', CASE WHEN t <= lock THEN 'early' ELSE 'late' END]) AS span FROM c WHERE closure IS NOT NULL),
a AS (SELECT type, span, key, count(*) AS n, count(*) FILTER (WHERE closure > 0) AS up, sum(closure) AS total, min(t) AS s, max(t) AS e, max(lock) AS lock FROM x GROUP BY 1, 2, 3), b AS (SELECT type, span, key % 7 AS game, sum(n) AS n, sum(up) AS up, sum(total) AS total, max(n) AS most, min(s) AS s, max(e) AS e, max(lock) AS lock FROM a GROUP BY 1, 2, 3),
g AS (SELECT type, span, CAST(sum(n) AS BIGINT) AS n, sum(up)::DOUBLE / sum(n) AS toward, sum(total) / sum(n) AS closure, max(most)::DOUBLE / sum(n) AS key_share, max(n)::DOUBLE / sum(n) AS game_share, CASE WHEN min(s) >= max(lock) THEN 'validation' WHEN max(e) <= max(lock) THEN 'discovery' ELSE 'mixed' END AS kind FROM b GROUP BY 1, 2)
SELECT type, span, n, toward, round(closure, 6) AS closure, round(key_share, 9) AS key_share, round(game_share, 9) AS game_share, kind, concat_ws(',', CASE WHEN n < 75 THEN 'sample_n_ge_75' END, CASE WHEN n < 150 THEN 'sample_n_ge_150_preferred' END, CASE WHEN NOT coalesce(toward >= 0.55, false) THEN 'toward_60m_ge_0_55' END, CASE WHEN NOT coalesce(closure > 0, false) THEN 'closure_60m_positive' END,
CASE WHEN key_share > 0.34 THEN 'max_ticker_share_le_0_34' END, CASE WHEN game_share > 0.5 THEN 'max_game_share_le_0_50' END, CASE WHEN kind <> 'validation' THEN 'out_of_sample_window' END) AS failed,
CASE {_ROLE} WHEN 'baseline' THEN 'baseline' WHEN 'negative_control' THEN CASE WHEN n < 12 THEN 'insufficient_sample' WHEN {_ADVERSE} THEN 'control_consistent' ELSE 'control_anomaly' END ELSE CASE WHEN n < 12 THEN 'sample_collapsed' WHEN {_ADVERSE} OR key_share > 0.34 OR game_share > 0.5 THEN 'failing_gates'
WHEN {_QUANT} THEN CASE WHEN kind = 'validation' THEN 'validated_shadow' ELSE 'passes_gates_discovery_only' END WHEN n < 75 THEN 'insufficient_sample' ELSE 'inconclusive_continue_observing' END END AS state FROM g""")
def gate_states(spark: SparkSession, d: str) -> DataFrame:
    """Seven gates and the state of each type's anchors, before a lock, after it and over both; concentration is counted by key, then by game."""
    rows = closures(spark, d).select("type", "key", "t", "closure")
    lock = ticks(spark, d).agg(F.expr("(min(t) + max(t)) div 2").alias("lock"))
    x = rows.where("closure IS NOT NULL").join(F.broadcast(lock)).withColumn("span", F.explode(F.array(F.lit("all"), F.when(F.col("t") <= F.col("lock"), "early").otherwise("late"))))
    a = x.groupBy("type", "span", "key").agg(F.count("*").alias("n"), stats.count_where(F.col("closure") > 0).alias("up"), F.sum("closure").alias("total"), F.min("t").alias("s"), F.max("t").alias("e"), F.max("lock").alias("lock"))
    b = a.groupBy("type", "span", (F.col("key") % 7).alias("game")).agg(F.max("n").alias("most"), *[F.sum(c).alias(c) for c in ("n", "up", "total")], F.min("s").alias("s"), F.max("e").alias("e"), F.max("lock").alias("lock"))
    n = F.sum("n")
    g = b.groupBy("type", "span").agg(
        n.alias("n"), stats.rate(F.sum("up"), n).alias("toward"), (F.sum("total") / n).alias("closure"), stats.rate(F.max("most"), n).alias("key_share"), stats.rate(F.max("n"), n).alias("game_share"),
        G.window_type(F.min("s"), F.max("e"), F.max("lock")).alias("kind"),
    )
    facts = [F.col(c) for c in ("n", "toward", "closure", "key_share", "game_share", "kind")]
    failed = F.array_join(F.array_compact(F.array(*[F.when(~c, F.lit(name)) for name, c in G.gates(*facts).items()])), ",")
    whole = [F.round(c, p).alias(c) for c, p in (("closure", 6), ("key_share", 9), ("game_share", 9))]
    return g.select("type", "span", "n", "toward", *whole, "kind", failed.alias("failed"), G.status(F.expr(_ROLE), *facts).alias("state"))
