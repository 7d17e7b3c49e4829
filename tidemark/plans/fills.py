"""What a fill cost, with absent parts kept absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import absence as A
from ..operators import asof, fills
from .registry import micros, query, table

# Whole amounts drawn from an order's key, in SQL that both engines read alike.
_PARTS = {
    "signatures": "CASE WHEN k % 19 <> 0 THEN 1 + k % 3 END",
    "fee": "CASE WHEN k % 23 <> 0 THEN 5000 * (1 + k % 3) + CASE WHEN k % 29 = 0 THEN -10 ELSE k % 50 * 20 END END",
    "price": "CASE WHEN k % 4 <> 0 AND k % 31 <> 0 THEN k % 50 * 100 + CASE WHEN k % 41 = 0 THEN 37 ELSE 0 END END",
    "price_reason": "CASE WHEN k % 4 = 0 THEN 'not_provided' ELSE 'not_reconstructable' END",
    "unit_limit": "CASE WHEN k % 37 <> 0 THEN 200000 + k % 2 END",
    "tip": "CASE WHEN k % 5 <> 0 THEN k % 1000 END",
}


@query(f"""WITH o AS (SELECT o_orderkey AS k FROM orders), p AS (SELECT k, {', '.join(f'{e} AS {n}' for n, e in _PARTS.items())} FROM o),
r AS (SELECT *, signatures * 5000 AS base, CASE WHEN fee >= signatures * 5000 THEN fee - signatures * 5000 END AS residual, CASE WHEN price IS NULL AND price_reason = 'not_provided' THEN 0 ELSE (price * unit_limit + 999999) // 1000000 END AS budget FROM p),
s AS (SELECT *, CASE WHEN residual IS NOT NULL THEN NULL WHEN fee IS NULL THEN 'not_yet_observed' WHEN base IS NULL THEN 'not_reconstructable' ELSE 'conflicting_sources' END AS residual_reason, residual IS NOT NULL AND budget IS NOT NULL AND abs(residual - budget) > 1 AS apart FROM r),
t AS (SELECT *, CASE WHEN NOT apart THEN coalesce(residual, budget) END AS priority FROM s), u AS (SELECT *, CASE WHEN priority IS NOT NULL THEN NULL WHEN apart THEN 'conflicting_sources' ELSE residual_reason END AS priority_reason FROM t)
SELECT k AS o_orderkey, CAST(base AS BIGINT) AS base, CAST(residual AS BIGINT) AS residual, residual_reason, CAST(budget AS BIGINT) AS budget, CAST(priority AS BIGINT) AS priority, priority_reason, CAST(base + priority + tip AS BIGINT) AS cost,
CASE WHEN base + priority + tip IS NOT NULL THEN NULL WHEN base IS NULL THEN 'not_reconstructable' WHEN priority IS NULL THEN priority_reason ELSE 'not_yet_observed' END AS cost_reason FROM u""")
def network_costs(spark: SparkSession, d: str) -> DataFrame:
    """P31, of F2 the base fee, the residual and its cross-check with the budget: a cost with an unknown part is unknown."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).select("k", *[F.expr(e).alias(n) for n, e in _PARTS.items()])
    unseen = F.lit("not_yet_observed")
    rows = rows.select("k", A.base_fee(F.col("signatures")).alias("base"), A.maybe(F.col("fee"), unseen).alias("fee"), A.maybe(F.col("price"), F.col("price_reason")).alias("price"), A.maybe(F.col("unit_limit"), unseen).alias("most"), A.maybe(F.col("tip"), unseen).alias("tip"))
    rows = rows.withColumns({"residual": A.residual_fee(F.col("fee"), F.col("base")), "budget": A.budget_fee(F.col("price"), F.col("most"))})
    rows = rows.withColumn("priority", A.reconciled(F.col("residual"), F.col("budget")))
    rows = rows.withColumn("cost", A.combined(F.col("base"), F.col("priority"), F.col("tip")))
    return rows.select(
        F.col("k").alias("o_orderkey"), F.col("base.value").alias("base"), F.col("residual.value").alias("residual"), F.col("residual.reason").alias("residual_reason"), F.col("budget.value").alias("budget"),
        F.col("priority.value").alias("priority"), F.col("priority.reason").alias("priority_reason"), F.col("cost.value").alias("cost"), F.col("cost.reason").alias("cost_reason"),
    )


# Facts of an order's transaction, in SQL that both engines read alike: k is the order, cu its customer, st its status, c its price in cents.
_TX = {
    "party": "concat('c', cu)", "relayed": "k % 7 = 0", "failed": "st = 'F' AND k % 9 = 0", "fee": "CASE WHEN k % 23 <> 0 THEN 5000 * (1 + k % 2) + k % 50 * 20 END", "tip_units": "k % 1000 + 1",
    "destination": "CASE WHEN k % 4 = 0 THEN 'tip_one' WHEN k % 4 = 1 THEN 'tip_two' ELSE concat('friend', k % 5) END", "mint": "concat('m', k % 6)", "units": "c * 3 + k % 10", "opens": "k % 3 = 0",
    "owned": "k % 29 <> 0", "balances": "k % 31 <> 0", "tokens": "k % 37 <> 0", "readable": "k % 5 <> 0", "second": "k % 17 = 0", "decision": "CASE WHEN k % 11 <> 0 THEN k END",
}
_RENT, _START, _REGISTRY = 2039, 10_000_000_000, ["tip_one", "tip_two"]
_QUOTE = {"input_mint": "CASE WHEN k % 41 = 0 THEN 'other' ELSE 'native' END", "output_mint": "CASE WHEN k % 43 = 0 THEN 'other' ELSE concat('m', k % 6) END", "quoted_input": "c + CASE WHEN k % 8 = 0 THEN c ELSE 0 END", "least_output": "CASE WHEN k % 47 = 0 THEN c * 4 ELSE c * 2 END", "quoted_price": "3.0 + (k % 5) / 100.0"}


def _facts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cu"), F.col("o_orderstatus").alias("st"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"), micros("o_orderdate").alias("t"))
    return rows.select("*", *[F.expr(e).alias(n) for n, e in _TX.items()])


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """orders as transactions: each spends its price in native units for units of a mint; some fail, are relayed, hide an owner or come without balances, tokens or instructions."""
    f = _facts(spark, d)
    ok, zero = ~F.col("failed"), F.lit(0).cast("long")
    if_ok = lambda x: F.when(ok, x).otherwise(zero)
    rent = if_ok(F.when(F.col("opens"), _RENT).otherwise(0))
    spent = if_ok(F.col("c") + F.col("tip_units")) + rent
    fee = F.coalesce("fee", F.lit(5000).cast("long"))
    start = F.lit(_START).cast("long")
    payer = F.when(F.col("relayed"), "relay").otherwise(F.col("party"))
    keys = F.array(payer, F.concat(F.lit("a"), "k"), F.concat(F.lit("b"), "k"), F.col("destination"))
    tail = lambda x: F.when(F.col("relayed"), F.array(x)).otherwise(F.array().cast(x_type(x)))
    x_type = lambda x: "array<string>" if x is party else "array<long>"
    party = F.col("party")
    opened = F.when(F.col("opens"), 0).otherwise(_RENT).cast("long")
    pre = F.array(start, opened, F.lit(_RENT).cast("long"), F.lit(7).cast("long"))
    post = F.array(start - fee - F.when(F.col("relayed"), zero).otherwise(spent), opened + rent, F.lit(_RENT).cast("long"), 7 + if_ok(F.col("tip_units")))
    token = lambda at, mint, units, owner: F.struct(F.lit(at).alias("at"), owner.alias("owner"), mint.alias("mint"), units.cast("long").alias("units"), F.lit(6).alias("decimals"))
    owner = F.when(F.col("owned"), party)
    some = lambda c, x: F.when(F.col(c), x)
    return f.select(
        F.col("k").alias("signature"), "t", "party", "decision", F.when(F.col("failed"), "custom").alias("error"), F.col("fee").cast("long").alias("fee"), F.concat(keys, tail(party)).alias("keys"),
        some("balances", F.concat(pre, tail(start))).alias("pre"), some("balances", F.concat(post, tail(start - spent))).alias("post"),
        some("tokens", F.array(token(1, F.col("mint"), F.lit(4), owner))).alias("pre_tokens"),
        some("tokens", F.concat(F.array(token(1, F.col("mint"), 4 + if_ok(F.col("units")), owner)), F.when(F.col("second") & ok, F.array(token(2, F.lit("x"), F.lit(5), party))).otherwise(F.array().cast("array<struct<at: int, owner: string, mint: string, units: long, decimals: int>>")))).alias("post_tokens"),
        some("readable", F.array(F.struct(F.when(F.col("relayed"), party).otherwise(payer).alias("source"), F.col("destination").alias("destination"), F.col("tip_units").cast("long").alias("units")))).alias("transfers"),
    )


def quotes(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).where("k % 13 <> 0").select(F.col("k").alias("decision"), *[F.expr(e).cast("double" if n == "quoted_price" else "string" if n.endswith("mint") else "long").alias(n) for n, e in _QUOTE.items()])


# What must come of it, by arithmetic on the facts alone.
_DECODED = f"""f AS (SELECT k, cu, st, c, t, {', '.join(f'{e} AS {n}' for n, e in _TX.items())} FROM (SELECT o_orderkey AS k, o_custkey AS cu, o_orderstatus AS st, CAST(round(o_totalprice * 100) AS BIGINT) AS c, epoch_us(o_orderdate) AS t FROM orders)),
g AS (SELECT *, destination LIKE 'tip%' AS listed, balances AND (relayed OR fee IS NOT NULL) AS has_native, CASE WHEN failed OR NOT opens THEN 0 ELSE {_RENT} END AS rent, owned AND tokens AS seen FROM f),
h AS (SELECT *, CASE WHEN has_native THEN CASE WHEN failed THEN 0 ELSE -(c + CASE WHEN readable AND listed THEN 0 ELSE tip_units END + rent - CASE WHEN seen THEN rent ELSE 0 END) END END AS native,
 CASE WHEN balances THEN CASE WHEN listed AND NOT failed THEN tip_units ELSE 0 END WHEN readable THEN CASE WHEN listed THEN tip_units ELSE 0 END END AS tip, CASE WHEN readable THEN CASE WHEN listed THEN tip_units ELSE 0 END END AS attempted FROM g),
d AS (SELECT *, CASE WHEN failed THEN 'transaction_failed' WHEN NOT tokens THEN 'not_provided' WHEN native IS NULL OR native = 0 OR owned = second THEN 'not_reconstructable' END AS refusal, CASE WHEN owned THEN mint ELSE 'x' END AS om, CASE WHEN owned THEN units ELSE 5 END AS ou FROM h)"""


@query(f"""WITH {_DECODED} SELECT k AS signature, CAST(native AS BIGINT) AS native, CASE WHEN native IS NULL THEN 'not_reconstructable' END AS native_reason, CAST(CASE WHEN balances THEN CASE WHEN seen THEN rent ELSE 0 END END AS BIGINT) AS rent, CAST(tip AS BIGINT) AS tip, CASE WHEN tip IS NULL THEN 'not_reconstructable' END AS tip_reason, CAST(attempted AS BIGINT) AS tip_attempted,
CASE WHEN refusal IS NULL THEN 'native' END AS input_mint, CAST(CASE WHEN refusal IS NULL THEN -native END AS BIGINT) AS input, CASE WHEN refusal IS NULL THEN om END AS output_mint, CAST(CASE WHEN refusal IS NULL THEN ou END AS BIGINT) AS output, refusal FROM d""")
def decoded_fills(spark: SparkSession, d: str) -> DataFrame:
    """F1, of F2 the tip: what changed hands in each transaction, or why it can't be told."""
    rows = fills.decoded(transactions(spark, d), _REGISTRY)
    value = lambda c: F.col(f"{c}.value").alias(c)
    return rows.select("signature", value("native"), F.col("native.reason").alias("native_reason"), value("rent"), value("tip"), F.col("tip.reason").alias("tip_reason"), value("tip_attempted"), "input_mint", value("input"), "output_mint", value("output"), "refusal")


_LINKED = f"""{_DECODED}, q AS (SELECT k, {', '.join(f'{e} AS {n}' for n, e in _QUOTE.items())} FROM f WHERE k % 13 <> 0),
l AS (SELECT d.*, q.k AS quote, q.input_mint AS q_in, q.output_mint AS q_out, q.quoted_input, q.least_output, q.quoted_price, list_filter([CASE WHEN decision IS NULL THEN 'no_decision' END, CASE WHEN decision IS NOT NULL AND q.k IS NULL THEN 'no_quote' END, CASE WHEN refusal IS NULL AND q.input_mint <> 'native' THEN 'input_mint_mismatch' END,
 CASE WHEN refusal IS NULL AND q.output_mint <> om THEN 'output_mint_mismatch' END, CASE WHEN refusal IS NULL AND q.output_mint = om AND ou < least_output THEN 'min_output_breach' END], lambda x: x IS NOT NULL) AS refusals FROM d LEFT JOIN q ON q.k = d.decision)"""
_PRICE = "((ou / 1000000.0::DOUBLE) / (-native / 1000000000.0::DOUBLE))"


@query(f"""WITH {_LINKED} SELECT k AS signature, array_to_string(refusals, ',') AS refusals, len(refusals) = 0 AS linked, CASE WHEN len(refusals) = 0 AND refusal IS NULL THEN round((quoted_price - {_PRICE}) / quoted_price, 9) END AS slippage,
CASE WHEN len(refusals) = 0 AND refusal IS NULL THEN round(-native::DOUBLE / quoted_input, 9) END AS fill_ratio, CASE WHEN len(refusals) = 0 AND refusal IS NULL THEN -native < quoted_input END AS partial FROM l""")
def linked_fills(spark: SparkSession, d: str) -> DataFrame:
    """Fills held against the quotes that they name; mints and the least output may refute the link."""
    rows = fills.linked(fills.decoded(transactions(spark, d), _REGISTRY), quotes(spark, d))
    return rows.select("signature", F.array_join("refusals", ",").alias("refusals"), "linked", F.round("slippage", 9).alias("slippage"), F.round("fill_ratio", 9).alias("fill_ratio"), "partial")


_MARK, _WITHIN = 30 * 86_400_000_000, 20 * 86_400_000_000


def _status(rows: DataFrame) -> Column:
    return F.when(F.col("error").isNotNull(), "failed").when(F.col("refusal").isNotNull(), "undecodable").otherwise("confirmed")


@query(f"""WITH {_LINKED}, p AS (SELECT cu AS key, t, arg_min(c, k) AS price FROM f GROUP BY 1, 2),
m AS (SELECT l.k, min((abs(p.t - l.t - {_MARK}), p.t, p.price)) AS x FROM l LEFT JOIN p ON p.key = l.cu AND abs(p.t - l.t - {_MARK}) <= {_WITHIN} GROUP BY 1)
SELECT l.k AS signature, CASE WHEN failed THEN 'failed' WHEN refusal IS NOT NULL THEN 'undecodable' ELSE 'confirmed' END AS status, len(refusals) = 0 AS linked, CAST(CASE WHEN failed THEN 0 ELSE 1 END * coalesce(tip, 0) + coalesce(fee, 0) AS BIGINT) AS known_cost,
fee IS NOT NULL AND tip IS NOT NULL AS cost_known, CAST(x[3] AS BIGINT) AS mark, CAST(x[1] AS BIGINT) AS mark_distance, CASE WHEN x[3] IS NULL THEN 'no_price_near' ELSE 'observed' END AS mark_source FROM l JOIN m USING (k)""")
def realized_fills(spark: SparkSession, d: str) -> DataFrame:
    """one row per transaction: status, link, cost and the price a month on; what no source gives stays absent and is named."""
    rows = fills.linked(fills.decoded(transactions(spark, d), _REGISTRY), quotes(spark, d))
    facts = _facts(spark, d).select(F.col("cu").alias("key"), F.col("k").alias("id"), "t", F.col("c").alias("price"))
    marks = asof.nearest(facts.select("key", "id", "t"), facts, "key", "t", "id", "price", _MARK, _WITHIN).select(F.col("id").alias("signature"), F.col("near_value").alias("mark"), F.col("near_distance").alias("mark_distance"))
    cost = A.combined(F.struct(F.col("fee").alias("value"), F.when(F.col("fee").isNull(), "not_provided").alias("reason")), F.col("tip"))
    return rows.join(marks, "signature").select(
        "signature", _status(rows).alias("status"), "linked", (F.when(F.col("error").isNull(), F.coalesce("tip.value", F.lit(0))).otherwise(0) + F.coalesce("fee", F.lit(0))).cast("long").alias("known_cost"),
        cost["reason"].isNull().alias("cost_known"), "mark", "mark_distance", F.when(F.col("mark").isNull(), "no_price_near").otherwise("observed").alias("mark_source"),
    )


_MODELLED = "CASE WHEN k % 6 <> 0 THEN 5000 * (1 + k % 2) END"


@query(f"""WITH {_LINKED}, p AS (SELECT l.*, {_PRICE} AS price, CASE WHEN k % 10 <> 0 THEN 2.9 + (k % 7) / 100.0::DOUBLE END AS bench, {_MODELLED} AS modelled, fee + tip AS paid FROM l),
t AS (SELECT k, len(refusals) = 0 AND refusal IS NULL AS linked, (bench - price) / bench AS price_real, (bench - quoted_price) / bench AS price_quote, paid / 1e9::DOUBLE / (c / 1e9::DOUBLE) AS fee_real, modelled / 1e9::DOUBLE / (c / 1e9::DOUBLE) AS fee_quote FROM p)
SELECT k AS signature, round(CASE WHEN linked THEN price_real + fee_real END, 9) AS realized, round(CASE WHEN linked THEN price_quote + fee_quote END, 9) AS quoted, round(CASE WHEN linked THEN price_real + fee_real - price_quote - fee_quote END, 9) AS residual, round(CASE WHEN linked THEN price_real - price_quote END, 9) AS price_residual,
CASE WHEN NOT linked THEN 'not_linked' WHEN price_real IS NULL THEN 'no_benchmark' WHEN fee_real IS NULL THEN 'cost_unknown' WHEN fee_quote IS NULL THEN 'no_model' WHEN abs(price_real + fee_real - price_quote - fee_quote) <= 0.0005 THEN 'as_quoted' WHEN price_real + fee_real > price_quote + fee_quote THEN 'adverse' ELSE 'better' END AS reading FROM t""")
def cost_residuals(spark: SparkSession, d: str) -> DataFrame:
    """What a linked fill cost against a benchmark, price and fees together, less what its quote and a fee stated beforehand said; an absent part makes the sum absent, and is named."""
    rows = fills.linked(fills.decoded(transactions(spark, d), _REGISTRY), quotes(spark, d))
    k = F.col("signature")
    facts = _facts(spark, d).select(F.col("k").alias("signature"), "c", F.expr(_MODELLED).alias("modelled"))
    said = quotes(spark, d).select(F.col("decision").alias("signature"), "quoted_price")
    rows = rows.join(facts, "signature").join(said, "signature", "left")
    bench = F.when(k % 10 != 0, F.lit(2.9) + (k % 7) / F.lit(100.0))
    of = lambda price: (bench - price) / bench  # noqa: E731  more for the same is a gain
    fee = lambda units: units / F.lit(1e9) / (F.col("c") / F.lit(1e9))
    stands = F.col("linked") & F.col("refusal").isNull()
    parts = {"price_real": of(fills.price()), "price_quote": of(F.col("quoted_price")), "fee_real": fee(F.col("fee") + F.col("tip.value")), "fee_quote": fee(F.col("modelled"))}
    rows = rows.select("signature", stands.alias("stands"), *[c.alias(n) for n, c in parts.items()])
    real, quote = F.col("price_real") + F.col("fee_real"), F.col("price_quote") + F.col("fee_quote")
    to = lambda c: F.round(F.when(F.col("stands"), c), 9)
    reading = (
        F.when(~F.col("stands"), "not_linked").when(F.col("price_real").isNull(), "no_benchmark").when(F.col("fee_real").isNull(), "cost_unknown").when(F.col("fee_quote").isNull(), "no_model")
        .when(F.abs(real - quote) <= 0.0005, "as_quoted").when(real > quote, "adverse").otherwise("better")
    )
    return rows.select("signature", to(real).alias("realized"), to(quote).alias("quoted"), to(real - quote).alias("residual"), to(F.col("price_real") - F.col("price_quote")).alias("price_residual"), reading.alias("reading"))


@query("""WITH f AS (SELECT o_orderkey AS k, o_custkey AS cu, CAST(round(o_totalprice * 100) AS BIGINT) AS c, epoch_us(o_orderdate) AS t FROM orders), p AS (SELECT cu AS key, t, arg_min(c, k) AS price FROM f GROUP BY 1, 2),
""" + f"""m AS (SELECT f.k, f.c, min((abs(p.t - f.t - {_MARK}), p.t, p.price)) AS x FROM f LEFT JOIN p ON p.key = f.cu AND abs(p.t - f.t - {_MARK}) <= {_WITHIN} GROUP BY 1, 2),
s AS (SELECT CASE WHEN k % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * (x[3] - c)::DOUBLE / nullif(c, 0) AS signed FROM m)
SELECT side, count(*) AS fills, count(signed) AS marked, CAST(count(*) FILTER (WHERE signed < 0) AS BIGINT) AS adverse, round(avg(signed), 6) AS mean_signed, CASE WHEN count(signed) < 12 THEN 'too_thin' WHEN avg(signed) < 0 AND count(*) FILTER (WHERE signed < 0) * 2 > count(signed) THEN 'adverse' ELSE 'not_adverse' END AS reading FROM s GROUP BY 1""")
def adverse_selection(spark: SparkSession, d: str) -> DataFrame:
    """How the price a month on lies to the fill's, by side; below zero the fills had were those not wanted. Fills without a price near are counted, not marked."""
    facts = _facts(spark, d).select(F.col("cu").alias("key"), F.col("k").alias("id"), "t", F.col("c").alias("price"))
    marks = asof.nearest(facts, facts, "key", "t", "id", "price", _MARK, _WITHIN)
    buy = F.col("id") % 2 == 0
    signed = F.when(buy, 1).otherwise(-1) * (F.col("near_value") - F.col("price")) / F.nullif(F.col("price"), F.lit(0))
    by = marks.select(F.when(buy, "buy").otherwise("sell").alias("side"), signed.alias("signed")).groupBy("side").agg(F.count("*").alias("fills"), F.count("signed").alias("marked"), F.count(F.when(F.col("signed") < 0, 1)).alias("adverse"), F.avg("signed").alias("mean"))
    reading = F.when(F.col("marked") < 12, "too_thin").when((F.col("mean") < 0) & (F.col("adverse") * 2 > F.col("marked")), "adverse").otherwise("not_adverse")
    return by.select("side", "fills", "marked", "adverse", F.round("mean", 6).alias("mean_signed"), reading.alias("reading"))
