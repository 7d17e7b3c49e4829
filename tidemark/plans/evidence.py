"""Anchoring, timing, gates, clocks, forecasts from evidence, and identity ladders."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import agents as A
from ..functions import labels as L
from ..functions import stats
from ..operators import asof, buckets
from ..operators import drift as drifts
from ..sources import tables
from .market import _FOLLOW, closures
from .registry import FORECASTS, TICKS, forecasts, micros, query, table, ticks


@query(f"""WITH {TICKS}, p AS (SELECT id, cents, lag(cents) OVER w AS prev, lag(cents, 2) OVER w AS older FROM ticks WINDOW w AS (PARTITION BY key ORDER BY t, id)), m AS (SELECT id, (cents - prev) / 10000.0::DOUBLE AS fm, (prev - older) / 10000.0::DOUBLE AS mm FROM p)
SELECT id, CASE WHEN fm IS NULL OR mm IS NULL THEN 'unclassifiable' WHEN abs(mm) < 0.02 THEN 'market_static' WHEN abs(fm) < 0.01 THEN 'anchored' WHEN (fm > 0) <> (mm > 0) THEN 'moved_against' WHEN abs(fm) < 0.5 * abs(mm) THEN 'partial' ELSE 'moved_with' END AS bucket FROM m""")
def forecast_anchor(spark: SparkSession, d: str) -> DataFrame:
    """A value's move against the move before it."""
    w = Window.partitionBy("key").orderBy("t", "id")
    t = ticks(spark, d).withColumn("prev", F.lag("cents").over(w)).withColumn("older", F.lag("cents", 2).over(w))
    return t.select("id", L.adjustment((F.col("cents") - F.col("prev")) / 10000.0, (F.col("prev") - F.col("older")) / 10000.0).alias("bucket"))


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'A' THEN CAST(l_quantity AS INT) END AS bid, CASE WHEN l_linestatus = 'F' OR l_returnflag = 'N' THEN CAST(l_quantity AS INT) + l_linenumber - 1 END AS ask FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN ask - bid IS NULL THEN 'missing_quotes' WHEN ask - bid >= 5 THEN 'wide' WHEN ask - bid >= 3 THEN 'moderate' ELSE 'tight' END AS quality FROM q""")
def quote_quality(spark: SparkSession, d: str) -> DataFrame:
    """A one-sided quote is missing, not wide."""
    q = F.col("l_quantity").cast("int")
    bid = F.when(F.col("l_returnflag") != "A", q)
    ask = F.when((F.col("l_linestatus") == "F") | (F.col("l_returnflag") == "N"), q + F.col("l_linenumber") - 1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", L.quote_quality(bid, ask).alias("quality"))


_GATES = {"enough": "samples >= 12", "toward": "coalesce(toward_rate >= 0.5, false)", "not_away": "coalesce(away_rate < 0.5, false)", "spread_keys": "keys >= 10"}


@query(_FOLLOW + f""", c AS (SELECT type, key, (CASE WHEN after_60m IS NOT NULL AND cents <> 5000 THEN (CASE WHEN 5000 > cents THEN after_60m - cents ELSE cents - after_60m END)::DOUBLE / abs(5000 - cents) END) AS closure FROM f),
s AS (SELECT type, count(closure) AS samples, count(*) FILTER (WHERE closure > 0)::DOUBLE / nullif(count(closure), 0) AS toward_rate, count(*) FILTER (WHERE closure <= -0.25)::DOUBLE / nullif(count(closure), 0) AS away_rate, count(DISTINCT CASE WHEN closure IS NOT NULL THEN key END) AS keys FROM c GROUP BY 1)
SELECT type, {', '.join(f'{c} AS {n}' for n, c in _GATES.items())}, {' AND '.join(f'({c})' for c in _GATES.values())} AS passes FROM s""")
def selection_gates(spark: SparkSession, d: str) -> DataFrame:
    """Four gates of this report on follow-through by type; a cohort passes if all hold. The gates of A29 are in gate_states."""
    n = F.count("closure")
    s = closures(spark, d).groupBy("type").agg(
        n.alias("samples"), stats.rate(stats.count_where(F.col("closure") > 0), n).alias("toward_rate"), stats.rate(stats.count_where(F.col("closure") <= L.AWAY), n).alias("away_rate"),
        F.count_distinct(F.when(F.col("closure").isNotNull(), F.col("key"))).alias("keys"),
    )
    gates = [F.expr(c).alias(n) for n, c in _GATES.items()]
    return s.select("type", *gates, F.forall(F.array(*[F.expr(c) for c in _GATES.values()]), lambda x: x).alias("passes"))


@query("""WITH c AS (SELECT conv_id, turn, turn // 4 AS epoch, turn * 1000 + conv_id % 7 AS mono, lag(turn // 4) OVER w AS pe, lag(turn * 1000 + conv_id % 7) OVER w AS pm, text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN pe IS NULL OR pe <> epoch OR text IS NULL THEN NULL ELSE mono - pm END AS us, CASE WHEN pe IS NULL THEN 'no_prior' WHEN pe <> epoch THEN 'epoch_differs' WHEN text IS NULL THEN 'no_payload' ELSE 'measured' END AS reason FROM c""")
def clock_intervals(spark: SparkSession, d: str) -> DataFrame:
    """An interval only within one epoch of a clock, else null with the reason."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("epoch", F.floor(F.col("turn") / 4)).withColumn("mono", F.col("turn") * 1000 + F.col("conv_id") % 7)
    c = c.withColumn("pe", F.lag("epoch").over(w)).withColumn("pm", F.lag("mono").over(w))
    reason = L.first_reason([(F.col("pe").isNull(), "no_prior"), (F.col("pe") != F.col("epoch"), "epoch_differs"), (F.col("text").isNull(), "no_payload")], "measured")
    return c.select("conv_id", "turn", F.when(reason == "measured", F.col("mono") - F.col("pm")).alias("us"), reason.alias("reason"))


@query("""SELECT p_partkey, CAST(ntile(4) OVER w AS INT) AS quarter, round(percent_rank() OVER w, 9) AS share, first_value(p_partkey) OVER w AS leader, round(p_retailprice / sum(CAST(round(p_retailprice * 100) AS BIGINT)) OVER (PARTITION BY p_brand) * 100, 9) AS of_total FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)""")
def rank_shares(spark: SparkSession, d: str) -> DataFrame:
    """Quartile, percent rank, leader and share of the total per brand."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    total = F.sum(F.round(F.col("p_retailprice") * 100).cast("long")).over(Window.partitionBy("p_brand"))
    return table(spark, d, "part").select("p_partkey", F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("share"), F.first("p_partkey").over(w).alias("leader"), F.round(F.col("p_retailprice") / total * 100, 9).alias("of_total"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def offset_page(spark: SparkSession, d: str) -> DataFrame:
    """A later page."""
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(50).limit(25)


@query(f"""WITH {TICKS} SELECT t - t % 21600000000 AS bucket, count(*) AS n, count(DISTINCT key) AS keys, CAST(count(*) FILTER (WHERE type = 'error') AS BIGINT) AS errors, max(cents) AS worst, CASE WHEN count(*) < 20 THEN 'thin' WHEN count(*) FILTER (WHERE type = 'error') * 5 > count(*) THEN 'degraded' ELSE 'ok' END AS state FROM ticks GROUP BY 1""")
def interval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """R14, of R13 the counters per interval and what they say; nothing is validated here."""
    errors = stats.count_where(F.col("type") == "error")
    return ticks(spark, d).groupBy(buckets.bucket_start(F.col("t"), 21_600).alias("bucket")).agg(
        F.count("*").alias("n"), F.count_distinct("key").alias("keys"), errors.alias("errors"), F.max("cents").alias("worst"),
        F.when(F.count("*") < 20, "thin").when(errors * 5 > F.count("*"), "degraded").otherwise("ok").alias("state"),
    )


@query(f"""WITH {FORECASTS}, e AS (SELECT id, CASE WHEN p % 10 <> 0 THEN p / 1000.0::DOUBLE END AS mid, toxic = 1 AS gap, lang, y FROM forecasts)
SELECT id, round(greatest(0.02, least(0.98, coalesce(mid, 0.5))), 9) AS estimate, round(least(CASE WHEN gap THEN 0.40 ELSE 0.75 END, 0.30 + CASE WHEN lang = 'en' THEN 0.10 ELSE 0 END + CASE WHEN y = 1 THEN 0.05 ELSE 0 END + CASE WHEN mid IS NOT NULL THEN 0.05 ELSE 0 END), 9) AS confidence,
round(greatest(0.02, least(0.98, coalesce(mid, 0.5) + greatest(-0.1, least(0.1, (id % 11 - 5) * 0.04)))), 9) AS shifted FROM e""")
def baseline_forecast(spark: SparkSession, d: str) -> DataFrame:
    """G1; of G2 the capped shift: a clamped midpoint or one half, confidence by evidence under a cap, and a capped shift from the prior."""
    f = forecasts(spark, d)
    mid = F.when(F.col("p") % 10 != 0, F.col("p") / 1000.0)
    add = lambda c, x: F.when(c, x).otherwise(0.0)
    prior = F.coalesce(mid, F.lit(0.5))
    clamp = lambda c: F.greatest(F.lit(0.02), F.least(F.lit(0.98), c))
    confidence = 0.30 + add(F.col("lang") == "en", 0.10) + add(F.col("y") == 1, 0.05) + add(mid.isNotNull(), 0.05)
    shift = F.greatest(F.lit(-0.1), F.least(F.lit(0.1), (F.pmod("id", F.lit(11)) - 5) * 0.04))
    return f.select("id", F.round(clamp(prior), 9).alias("estimate"), F.round(F.least(F.when(F.col("toxic") == 1, 0.40).otherwise(0.75), confidence), 9).alias("confidence"), F.round(clamp(prior + shift), 9).alias("shifted"))


@query("""SELECT p_partkey, CASE WHEN p_name = '' THEN 'none' WHEN regexp_matches(p_name, '[0-9]+') THEN 'numbered' ELSE 'named' END AS kind, TRY_CAST(nullif(regexp_extract(p_name, '([0-9]+)', 1), '') AS BIGINT) AS line, regexp_extract(p_brand, '#([0-9])', 1) AS side FROM part""")
def market_spec(spark: SparkSession, d: str) -> DataFrame:
    """Of G3 a plain form: kind, line and side of a market from its name."""
    kind = F.when(F.col("p_name") == "", "none").when(F.col("p_name").rlike("[0-9]+"), "numbered").otherwise("named")
    line = F.nullif(F.regexp_extract("p_name", "([0-9]+)", 1), F.lit("")).cast("long")
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"), line.alias("line"), F.regexp_extract("p_brand", "#([0-9])", 1).alias("side"))


@query("""WITH e AS (SELECT c_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 3 WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END) AS rank, count(*) AS evidence FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT c_custkey, evidence, ['unresolved', 'candidate', 'probable', 'confirmed'][rank + 1] AS status, rank = 3 AS joins FROM e""")
def identity_ladder(spark: SparkSession, d: str) -> DataFrame:
    """the highest step that evidence reaches; only the top one joins."""
    rank = F.max(F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 2).otherwise(1))
    people = table(spark, d, "customer").select("c_custkey")
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus").join(people, "c_custkey", "left_semi").groupBy("c_custkey").agg(rank.alias("rank"), F.count("*").alias("evidence"))
    names = F.array(*[F.lit(x) for x in ("unresolved", "candidate", "probable", "confirmed")])
    return e.select("c_custkey", "evidence", F.get(names, F.col("rank")).alias("status"), (F.col("rank") == 3).alias("joins"))


@query(f"""WITH {TICKS}, r AS (SELECT key, t - t % 86400000000 AS day, count(*) >= 3 AS ready FROM ticks GROUP BY 1, 2), i AS (SELECT *, sum(CASE WHEN ready AND coalesce(pr, false) AND day - pd = 86400000000 THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY day) AS run FROM (SELECT *, lag(ready) OVER (PARTITION BY key ORDER BY day) AS pr, lag(day) OVER (PARTITION BY key ORDER BY day) AS pd FROM r) x)
SELECT key, min(day) AS first_day, count(*) AS days FROM i WHERE ready GROUP BY key, run""")
def ready_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive days on which a key has rows enough."""
    w = Window.partitionBy("key").orderBy("day")
    r = ticks(spark, d).groupBy("key", buckets.bucket_start(F.col("t"), 86_400).alias("day")).agg((F.count("*") >= 3).alias("ready"))
    goes_on = F.col("ready") & F.coalesce(F.lag("ready").over(w), F.lit(False)) & (F.col("day") - F.lag("day").over(w) == 86_400_000_000)
    runs = r.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return runs.where("ready").groupBy("key", "run").agg(F.min("day").alias("first_day"), F.count("*").alias("days")).drop("run")


@query("""WITH a AS (SELECT s_suppkey AS k, s_nationkey, s_acctbal, 'first' AS provider FROM supplier UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal + s_suppkey % 3, 'second' FROM supplier WHERE s_suppkey % 2 = 0)
SELECT k, max(s_acctbal) AS top_pct, bool_or(s_acctbal < 0) AS any_debt, arg_min(s_nationkey, provider) AS nation, count(*) AS providers FROM a GROUP BY 1""")
def merged_flags(spark: SparkSession, d: str) -> DataFrame:
    """P25: flags of several providers, the worse one of each kind: the largest share, any true, the first otherwise."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey", "s_acctbal")
    a = s.withColumn("provider", F.lit("first")).unionByName(s.where("k % 2 = 0").withColumn("s_acctbal", F.col("s_acctbal") + F.col("k") % 3).withColumn("provider", F.lit("second")))
    return a.groupBy("k").agg(F.max("s_acctbal").alias("top_pct"), F.bool_or(F.col("s_acctbal") < 0).alias("any_debt"), F.min_by("s_nationkey", "provider").alias("nation"), F.count("*").alias("providers"))


@query(f"""WITH {TICKS}, k AS (SELECT key, count(*) AS n, count(DISTINCT type) AS kinds, max(cents) AS top, min(cents) AS low, sum((type = 'error')::INT) AS errors FROM ticks GROUP BY 1),
s AS (SELECT key, CASE WHEN top > 9000 THEN 0.9 WHEN top > 5000 THEN 0.5 ELSE 0.1 END::DOUBLE AS structure, least(1.0, n / 100.0)::DOUBLE AS velocity, kinds / 5.0::DOUBLE AS coverage, errors::DOUBLE / n AS audit FROM k)
SELECT key, round(0.4 * structure + 0.3 * velocity + 0.2 * coverage + 0.1 * (1 - audit), 9) AS composite, CASE WHEN audit > 0.3 THEN 'blocked_by_audit' WHEN coverage < 0.6 THEN 'thin_coverage' WHEN structure >= 0.9 THEN 'review' ELSE 'watch' END AS reading FROM s""")
def diagnostic_agents(spark: SparkSession, d: str) -> DataFrame:
    """Of P26 one score per agent kind: several readings of one wide row per key, and their composite; the audit has the first word."""
    k = ticks(spark, d).groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("type").alias("kinds"), F.max("cents").alias("top"), stats.count_where(F.col("type") == "error").alias("errors"))
    structure = F.when(F.col("top") > 9000, 0.9).when(F.col("top") > 5000, 0.5).otherwise(0.1)
    velocity, coverage, audit = F.least(F.lit(1.0), F.col("n") / 100.0), F.col("kinds") / 5.0, F.col("errors") / F.col("n")
    composite = 0.4 * structure + 0.3 * velocity + 0.2 * coverage + 0.1 * (1 - audit)
    reading = L.first_reason([(audit > 0.3, "blocked_by_audit"), (coverage < 0.6, "thin_coverage"), (structure >= 0.9, "review")], "watch")
    return k.select("key", F.round(composite, 9).alias("composite"), reading.alias("reading"))


@query("""WITH p AS (SELECT l_suppkey AS token, l_orderkey AS pair, sum(CAST(l_quantity AS BIGINT)) AS liquidity, max(l_shipdate) AS seen FROM lineitem GROUP BY 1, 2)
SELECT token, arg_max(pair, (liquidity, -pair)) AS most_liquid, arg_max(pair, (seen, -pair)) AS most_recent, min(pair) AS first_known, arg_max(pair, (liquidity, -pair)) = arg_max(pair, (seen, -pair)) AS policies_agree FROM p GROUP BY 1""")
def pair_selection(spark: SparkSession, d: str) -> DataFrame:
    """Of P29 the selection: the pair that each policy picks for a token, in one aggregation."""
    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("token"), F.col("l_orderkey").alias("pair")).agg(F.sum(F.col("l_quantity").cast("long")).alias("liquidity"), F.max("l_shipdate").alias("seen"))
    liquid, recent = F.max_by("pair", F.struct("liquidity", -F.col("pair"))), F.max_by("pair", F.struct("seen", -F.col("pair")))
    return p.groupBy("token").agg(liquid.alias("most_liquid"), recent.alias("most_recent"), F.min("pair").alias("first_known"), (liquid == recent).alias("policies_agree"))


@query("""WITH o AS (SELECT o_orderpriority AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS v, o_orderdate >= TIMESTAMP '1995-06-01' AS late FROM orders)
SELECT k, CAST(sum(v) FILTER (WHERE NOT late) AS BIGINT) AS pinned, CAST(sum(v) FILTER (WHERE late) AS BIGINT) AS now, CASE WHEN count(*) FILTER (WHERE late) = 0 THEN 'absent' WHEN sum(v) FILTER (WHERE late) = sum(v) FILTER (WHERE NOT late) THEN 'same' ELSE 'drifted' END AS state FROM o GROUP BY 1""")
def drift(spark: SparkSession, d: str) -> DataFrame:
    """G17, of F5 the figures: pinned sums against those of now."""
    late = F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ'1995-06-01 00:00:00'")
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"), late.alias("late"))
    part = lambda x: F.sum(F.when(F.col("late") == x, F.col("v")))
    state = F.when(stats.count_where(F.col("late")) == 0, "absent").when(part(True) == part(False), "same").otherwise("drifted")
    return o.groupBy("k").agg(part(False).alias("pinned"), part(True).alias("now"), state.alias("state"))


@query(f"""WITH {TICKS}, k AS (SELECT type, key, t - t % 3600000000 AS hour FROM ticks), a AS (SELECT * FROM k WHERE type = 'view'), b AS (SELECT * FROM k WHERE type = 'click')
SELECT DISTINCT key, hour FROM a INTERSECT SELECT DISTINCT key, hour FROM b""")
def shared_hours(spark: SparkSession, d: str) -> DataFrame:
    """Hours that two kinds of events share."""
    k = ticks(spark, d).select("type", "key", buckets.bucket_start(F.col("t"), 3600).alias("hour"))
    return k.where("type = 'view'").select("key", "hour").intersect(k.where("type = 'click'").select("key", "hour"))


@query("SELECT event_id, epoch_us(ts) // 1000000 AS second, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS canonical, CAST(isoyear(ts) AS INT) AS iso_year, CAST(week(ts) AS INT) AS iso_week FROM events")
def canonical_times(spark: SparkSession, d: str) -> DataFrame:
    """Canonical timestamps and ISO weeks of events."""
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", F.floor(micros("ts") / 1_000_000).alias("second"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("canonical"), F.extract(F.lit("YEAROFWEEK"), ts).cast("int").alias("iso_year"), F.weekofyear(ts).alias("iso_week"))


_PINNED = ("p_brand", "p_name", "p_size", "p_type")
_LIVE = {"p_brand": "CASE WHEN p_partkey % 7 = 0 THEN concat(p_brand, '!') ELSE p_brand END", "p_name": "p_name", "p_size": "CASE WHEN p_partkey % 11 <> 0 THEN p_size END", "p_type": "CASE WHEN p_partkey % 21 = 0 THEN '' ELSE p_type END"}
_DIGEST = "sha256(concat_ws(chr(10), " + ", ".join(f"'{f}=' || coalesce('+' || {{0}}{f}, '-')" for f in _PINNED) + "))"


@query(f"""WITH a AS (SELECT p_partkey, {', '.join(_PINNED)}, {_DIGEST.format('')} AS digest FROM part WHERE p_partkey % 13 <> 0), l AS (SELECT p_partkey, {', '.join(f'{e} AS {n}' for n, e in _LIVE.items())} FROM part WHERE p_partkey % 17 <> 0), b AS (SELECT *, {_DIGEST.format('')} AS digest FROM l)
SELECT p_partkey, CASE WHEN b.digest IS NULL THEN 'unknown' WHEN a.digest IS NULL THEN 'unpinned' WHEN a.digest = b.digest THEN 'unchanged' ELSE 'drifted' END AS state,
CASE WHEN a.digest <> b.digest THEN array_to_string(list_filter([{', '.join(f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in _PINNED)}], lambda x: x IS NOT NULL), ',') ELSE '' END AS changed, a.digest AS pinned_digest, b.digest AS live_digest FROM a FULL JOIN b USING (p_partkey)""")
def subset_drift(spark: SparkSession, d: str) -> DataFrame:
    """pinned records against those of now by digests of the fields that matter; what couldn't be fetched is unknown, not drift."""
    part = table(spark, d, "part")
    live = part.where("p_partkey % 17 <> 0").select("p_partkey", "p_retailprice", *[F.expr(e).alias(n) for n, e in _LIVE.items()])
    return drifts.drift(part.where("p_partkey % 13 <> 0"), live, "p_partkey", list(_PINNED)).withColumn("changed", F.array_join("changed", ","))


_SLOTS, _LABEL = 20, "^[a-z_]{1,12}$"


@query(f"""WITH {TICKS}, g AS (SELECT t - t % 21600000000 AS bucket, t // 21600000000 AS b, count(*) AS n, count(DISTINCT type) AS types, count(DISTINCT key) AS keys FROM ticks GROUP BY 1, 2)
SELECT bucket, array_to_string(list_filter([CASE WHEN b % 7 = 1 THEN 'count' END, CASE WHEN b % 8 = 1 THEN 'ended' END, CASE WHEN b % 5 = 1 THEN 'environment' END, CASE WHEN b % 3 = 1 THEN 'histogram' END, CASE WHEN b % 11 = 1 THEN 'lost' END, CASE WHEN b % 9 = 1 THEN 'run' END, CASE WHEN keys > {_SLOTS} THEN 'slots' END], lambda x: x IS NOT NULL), ',') AS invalid FROM g""")
def interval_validation(spark: SparkSession, d: str) -> DataFrame:
    """Interval records against a closed schema: counts, clocks, pinned formats, histograms of labels only and lists of bounded length; the checks that don't hold are named."""
    t = ticks(spark, d).withColumn("bucket", buckets.bucket_start(F.col("t"), 21_600))
    kinds = t.groupBy("bucket", "type").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("type", "k"))).alias("histogram"))
    keys = t.groupBy("bucket").agg(F.count("*").alias("count"), F.count_distinct("key").alias("keys"))
    b = F.floor(F.col("bucket") / 21_600_000_000)
    one = lambda k: b % k == 1
    rows = keys.join(kinds, "bucket").select(
        "bucket", F.when(one(7), -F.col("count")).otherwise(F.col("count")).alias("count"), F.col("bucket").alias("started"), F.when(one(8), F.col("bucket") - 1).otherwise(F.col("bucket") + 1).alias("ended"), F.when(one(5), "TEST").otherwise("demo").alias("environment"),
        F.when(one(3), F.map_concat("histogram", F.create_map(F.lit("KX-26JUL"), F.lit(1).cast("long")))).otherwise(F.col("histogram")).alias("histogram"), F.when(one(11), F.lit(-1)).when(b % 2 == 0, F.lit(0)).alias("lost"), F.when(one(9), "run 7").otherwise("run-0007").alias("run"),
        F.sequence(F.lit(1), F.col("keys").cast("int")).alias("slots"),
    )
    checks = {
        "count": F.col("count") >= 0, "ended": F.col("ended") >= F.col("started"), "environment": F.col("environment").isin("demo", "prod"),
        "histogram": F.forall(F.map_entries("histogram"), lambda e: e["key"].rlike(_LABEL) & (e["value"] >= 0)) & (F.size("histogram") <= 16), "lost": F.col("lost").isNull() | (F.col("lost") >= 0), "run": F.col("run").rlike("^run-[0-9]{4}$"),
        "slots": (F.size("slots") <= _SLOTS) & F.forall("slots", lambda x: x >= 0),
    }
    return tables.validated(rows, checks).select("bucket", F.array_join("invalid", ",").alias("invalid"))


# Facts of a token, in SQL that both engines read alike: k is the part, c its price in cents, z its size.
_TOKEN = {
    "liquidity": "CASE WHEN k % 7 <> 0 THEN c * (k % 9) * 0.1 END", "volume": "CASE WHEN k % 8 <> 0 THEN c * (z % 11) * 0.2 END", "top10": "CASE WHEN k % 5 <> 0 THEN z END", "sniper": "CASE WHEN k % 6 <> 0 THEN k % 26 END", "insider": "CASE WHEN k % 10 <> 0 THEN k % 18 END",
    "bundler": "CASE WHEN k % 4 <> 0 THEN k % 29 END", "rug": "k % 53 = 0", "honeypot": "k % 59 = 0", "mint_open": "k % 13 = 0", "freeze_open": "k % 17 = 0", "confidence": "CASE WHEN k % 3 <> 0 THEN (k % 20) / 20.0 END", "attention": "CASE WHEN k % 9 <> 0 THEN (k % 25) / 20.0 END",
    "attention_before": "CASE WHEN k % 2 = 0 THEN (k % 15) / 20.0 END", "boost": "k % 12", "boost_velocity": "CASE WHEN k % 14 = 0 THEN 2 END", "social": "CASE WHEN k % 11 <> 0 THEN k % 2 = 0 END", "catalysts": "k % 5", "profile": "CASE WHEN k % 19 <> 0 THEN (k % 8) / 8.0 END",
    "age": "CASE WHEN k % 23 <> 0 THEN k % 40 * 7200 END", "liquidity_growth": "CASE WHEN k % 4 <> 1 THEN (k % 21 - 10) / 20.0 END", "volume_growth": "CASE WHEN k % 6 <> 1 THEN (k % 17 - 8) / 10.0 END", "snapshots": "k % 6", "level": "CASE WHEN k % 41 = 0 THEN 'severe' WHEN k % 31 = 0 THEN 'high' WHEN k % 21 = 0 THEN 'medium' END",
    "fake_volume": "k % 37 = 0", "removed": "k % 43 = 0", "spike": "k % 47 = 0", "provided": "CASE WHEN k % 15 <> 0 THEN k % 7 <> 3 END", "unknown_provider": "k % 18 = 0",
}
_AGENTS = {"structure": A.STRUCTURE, "velocity": A.VELOCITY, "timing": A.TIMING, "coverage": A.COVERAGE}


def _listed(reasons: tuple[tuple[str, str], ...]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in reasons) + ")"


def _doubles(sql: str) -> str:
    """Decimal literals as doubles, which both engines then add alike."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)", r"CAST(\1 AS DOUBLE)", sql)


@query(_doubles(f"""WITH p AS (SELECT p_partkey AS k, CAST(round(p_retailprice * 100) AS BIGINT) AS c, p_size AS z FROM part), f AS (SELECT k, {', '.join(f'{e} AS {n}' for n, e in _TOKEN.items())} FROM p),
a AS (SELECT *, {', '.join(f'{x.score()} AS {n}' for n, x in _AGENTS.items())}, {A.RISK} AS risk, concat_ws(';', {', '.join(_listed(x.reasons) for x in _AGENTS.values())}, {_listed(A.RISK_REASONS)}) AS trace FROM f), m AS (SELECT *, {A.MOMENTUM} AS momentum FROM a)
SELECT k AS p_partkey, structure, velocity, timing, coverage, risk, momentum, {A.REVIEW} AS review, {A.PRIORITY} AS priority, trace FROM m"""))
def token_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Structure, velocity, timing, coverage and risk of each token, and the priority of a review under one profile, gates included; the reasons of each in a trace."""
    sql = lambda e: F.expr(_doubles(e))
    f = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.round(F.col("p_retailprice") * 100).cast("long").alias("c"), F.col("p_size").alias("z"))
    f = f.select("k", *[sql(e).alias(n) for n, e in _TOKEN.items()])
    trace = F.concat_ws(";", *[F.expr(_listed(x.reasons)) for x in _AGENTS.values()], F.expr(_listed(A.RISK_REASONS)))
    a = f.withColumns({**{n: sql(x.score()) for n, x in _AGENTS.items()}, "risk": sql(A.RISK), "trace": trace}).withColumn("momentum", sql(A.MOMENTUM))
    return a.select(F.col("k").alias("p_partkey"), *_AGENTS, "risk", "momentum", sql(A.REVIEW).alias("review"), sql(A.PRIORITY).alias("priority"), "trace")
