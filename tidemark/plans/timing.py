"""When to measure: each trigger measured anew at the time of each of eight policies, over ticks that exist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import asof, windows
from .policies import _FACTS, _HOUR
from .registry import TICKS, query, ticks

#: Hours stand for minutes, as ticks of the tables are sparse. Prices in ten thousandths.
DELAYS = {"baseline_immediate": 0, "delay_2m": 2, "delay_5m": 5, "delay_10m": 10, "delay_15m": 15}
FLAT, STABLE, FOLLOWS = "wait_until_midpoint_flat_5m", "wait_until_spread_stable", "wait_until_gap_follows_move"
WINDOW, WAIT, LOOKBACK, FINAL = 5 * _HOUR, 30 * _HOUR, 10 * _HOUR, 60 * _HOUR
BAND, LEAST_GAP, SHARP = 1500, 500, 300
LOSSES = ("no_tick_at_delay", "gap_evaporated", "condition_never_met")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    facts = {n: _FACTS[n] for n in ("price", "gap", "spread_cents")}
    return ticks(spark, d).select("*", *[F.expr(e).alias(n) for n, e in facts.items()])


_R = f"{TICKS}, r AS (SELECT *, {', '.join(f'{_FACTS[n]} AS {n}' for n in ('price', 'gap', 'spread_cents'))} FROM ticks)"
_STRETCHES = f"""fl AS (SELECT a.key, a.t, a.id FROM r a JOIN r b ON a.key = b.key AND b.t BETWEEN a.t AND a.t + {WINDOW} GROUP BY 1, 2, 3, a.price HAVING count(*) >= 2 AND max(abs(b.price - a.price)) <= {BAND}),
eq AS (SELECT a.key, a.t, a.id FROM r a JOIN r b ON a.key = b.key AND b.t BETWEEN a.t AND a.t + {WINDOW} GROUP BY 1, 2, 3, a.spread_cents HAVING count(*) >= 2 AND bool_and(coalesce(b.spread_cents = a.spread_cents, false)))"""


@query(f"WITH {_R}, {_STRETCHES} SELECT 'flat' AS kind, key, id, t + {WINDOW} AS \"end\" FROM fl UNION ALL SELECT 'equal_spread', key, id, t + {WINDOW} FROM eq")
def calm_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Ticks after which the price stays within a band of theirs, and ticks after which the spread stays the same."""
    rows = _rows(spark, d)
    flat, equal = windows.flat_stretches(rows, "price", WINDOW, BAND), windows.equal_stretches(rows, "spread_cents", WINDOW)
    return flat.select(F.lit("flat").alias("kind"), "key", "id", "end").unionByName(equal.select(F.lit("equal_spread").alias("kind"), "key", "id", "end"))


def measured(probes: DataFrame, rows: DataFrame) -> DataFrame:
    """Probes (key, anchor, policy, start, forecast, at) with what is measured at ``at``, and in ``loss`` why it can't be.

    The tick must come after the trigger, unless the measurement is at the trigger itself; the forecast
    is held; a gap below the least one has gone. The pre-move is that since the first tick of the
    lookback before ``at``, the closure that of the last tick within the final horizon after it.
    """
    found = asof.carried(probes, "at", rows, ["price"], "now")
    found = asof.carried(found.withColumn("_from", F.col("at") - LOOKBACK), "_from", rows, ["price"], "before", ahead=True)
    found = asof.carried(found.withColumn("_until", F.col("at") + FINAL), "_until", rows, ["price"], "later")
    known = F.col("now").isNotNull() & F.col("forecast").isNotNull() & ((F.col("at") == F.col("start")) | (F.col("now.t") > F.col("start")))
    gap = F.col("forecast") - F.col("now.price")
    loss = F.when(F.col("at").isNull(), LOSSES[2]).when(~F.coalesce(known, F.lit(False)), LOSSES[0]).when(F.abs(gap) < LEAST_GAP, LOSSES[1])
    move = F.when(F.col("before.t") <= F.col("at"), F.col("now.price") - F.col("before.price"))
    closure = F.when(F.col("later.t") > F.col("at"), (F.col("later.price") - F.col("now.price")) / gap)
    out = found.withColumn("loss", loss)
    ok = F.col("loss").isNull()
    return out.select("anchor", "policy", "loss", *[F.when(ok, x).alias(n) for n, x in (("gap", gap), ("move", move), ("closure", closure))])


_PROBES = f"""tr AS (SELECT key, id AS anchor, t AS start, price + gap AS forecast FROM r WHERE type = 'signup'),
last AS (SELECT key, t, arg_max(price, id) AS price FROM r GROUP BY 1, 2),
pre AS (SELECT l.key, l.t, l.price, l.price - arg_min(b.price, (b.t, b.id)) AS move FROM last l JOIN r b ON b.key = l.key AND b.t BETWEEN l.t - {LOOKBACK} AND l.t GROUP BY 1, 2, 3),
ats AS ({' UNION ALL '.join(f"SELECT key, anchor, start, forecast, '{n}' AS policy, start + {m * _HOUR} AS due FROM tr" for n, m in DELAYS.items())}
UNION ALL SELECT tr.key, anchor, start, any_value(forecast), '{FLAT}', min(fl.t) + {WINDOW} FROM tr LEFT JOIN fl ON fl.key = tr.key AND fl.t > start AND fl.t <= start + {WAIT} GROUP BY 1, 2, 3
UNION ALL SELECT tr.key, anchor, start, any_value(forecast), '{STABLE}', min(eq.t) + {WINDOW} FROM tr LEFT JOIN eq ON eq.key = tr.key AND eq.t > start AND eq.t <= start + {WAIT} GROUP BY 1, 2, 3
UNION ALL SELECT tr.key, anchor, start, any_value(forecast), '{FOLLOWS}', min(pre.t) FROM tr LEFT JOIN pre ON pre.key = tr.key AND pre.t > start AND pre.t <= start + {WAIT} AND abs(forecast - pre.price) >= {LEAST_GAP} AND pre.move <> 0 AND (forecast > pre.price) = (pre.move > 0) GROUP BY 1, 2, 3)"""
_NOW = f"""n AS (SELECT *, (SELECT max((b.t, b.id, b.price)) FROM r b WHERE b.key = ats.key AND b.t <= due) AS now, (SELECT min((b.t, b.id, b.price)) FROM r b WHERE b.key = ats.key AND b.t BETWEEN due - {LOOKBACK} AND due) AS before, (SELECT max((b.t, b.id, b.price)) FROM r b WHERE b.key = ats.key AND b.t > due AND b.t <= due + {FINAL}) AS later FROM ats),
m AS (SELECT anchor, policy, forecast - now[3] AS gap, now[3] - before[3] AS move, (later[3] - now[3])::DOUBLE / nullif(forecast - now[3], 0) AS closure, CASE WHEN due IS NULL THEN 'condition_never_met' WHEN now IS NULL OR forecast IS NULL OR NOT (due = start OR now[1] > start) THEN 'no_tick_at_delay' WHEN abs(forecast - now[3]) < {LEAST_GAP} THEN 'gap_evaporated' END AS loss FROM n)"""


@query(f"""WITH {_R}, {_STRETCHES}, {_PROBES}, {_NOW} SELECT policy, count(*) AS triggers, CAST(count(*) FILTER (WHERE loss IS NULL) AS BIGINT) AS measured, {', '.join(f"CAST(count(*) FILTER (WHERE loss = '{x}') AS BIGINT) AS {x}" for x in LOSSES)},
CAST(count(*) FILTER (WHERE loss IS NULL AND abs(move) >= {SHARP}) AS BIGINT) AS sharp, CAST(count(*) FILTER (WHERE loss IS NULL AND move <> 0 AND (gap > 0) <> (move > 0)) AS BIGINT) AS opposes, CAST(count(*) FILTER (WHERE loss IS NULL AND closure IS NOT NULL) AS BIGINT) AS samples, CAST(count(*) FILTER (WHERE loss IS NULL AND closure > 0) AS BIGINT) AS toward,
CAST(count(*) FILTER (WHERE loss IS NULL AND closure <= -0.25) AS BIGINT) AS away, round(avg(closure) FILTER (WHERE loss IS NULL), 4) AS mean_closure FROM m GROUP BY 1""")
def timing_policies(spark: SparkSession, d: str) -> DataFrame:
    """Eight policies, with the reasons of what they lose; a wait ends after a limit.

    Fixed delays are added to the trigger; flat prices and equal spreads are found by an as-of look ahead;
    only the policy whose condition hangs on both trigger and tick pairs them, within the wait.
    """
    rows = _rows(spark, d)
    triggers = rows.where("type = 'signup'").select("key", F.col("id").alias("anchor"), F.col("t").alias("start"), (F.col("price") + F.col("gap")).alias("forecast"))
    delays = F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), F.lit(m * _HOUR).alias("wait")) for n, m in DELAYS.items()])).alias("p")
    probes = [triggers.select("*", delays).select("key", "anchor", "start", "forecast", "p.policy", (F.col("start") + F.col("p.wait")).alias("at"))]
    for name, marks in ((FLAT, windows.flat_stretches(rows, "price", WINDOW, BAND)), (STABLE, windows.equal_stretches(rows, "spread_cents", WINDOW))):
        ahead = asof.carried(triggers.withColumn("_after", F.col("start") + 1), "_after", marks, ["end"], "mark", ahead=True)
        probes.append(ahead.select("key", "anchor", "start", "forecast", F.lit(name).alias("policy"), F.when(F.col("mark.t") <= F.col("start") + WAIT, F.col("mark.end")).alias("at")))
    last = asof.first_in_lookback(rows, "price", "first", LOOKBACK).groupBy("key", "t").agg(F.max_by("price", "id").alias("price"), F.max_by("first", "id").alias("first"))
    last = last.withColumn("move", F.col("price") - F.col("first")).where("move <> 0")
    follows = windows.within_wait(triggers, last, WAIT).where((F.abs(F.col("forecast") - F.col("price")) >= LEAST_GAP) & ((F.col("forecast") > F.col("price")) == (F.col("move") > 0)))
    at = follows.groupBy("key", "anchor").agg(F.min("t").alias("at"))
    probes.append(triggers.join(at, ["key", "anchor"], "left").select("key", "anchor", "start", "forecast", F.lit(FOLLOWS).alias("policy"), "at"))
    m = measured(reduce(DataFrame.unionByName, probes), rows)
    return m.groupBy("policy").agg(
        F.count("*").alias("triggers"), stats.count_where(F.col("loss").isNull()).alias("measured"), *[stats.count_where(F.col("loss") == x).alias(x) for x in LOSSES],
        stats.count_where(F.abs("move") >= SHARP).alias("sharp"), stats.count_where((F.col("move") != 0) & ((F.col("gap") > 0) != (F.col("move") > 0))).alias("opposes"),
        F.count("closure").alias("samples"), stats.count_where(F.col("closure") > 0).alias("toward"), stats.count_where(F.col("closure") <= -0.25).alias("away"), F.round(F.avg("closure"), 4).alias("mean_closure"),
    )
