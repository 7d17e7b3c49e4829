"""Transactions decoded to what changed hands and what it cost, and linked to the quotes that they answer.

Everything is in a transaction's own row (balances before and after by account, token balances, transfers), so decoding is
column expressions over its arrays, without a shuffle; only linking joins. What isn't known is absent for a reason and
never zero: a native leg without a fee isn't stated, and a failed transaction moves nothing but its fee.

transactions: signature, party, error, fee, keys (accounts; the first pays), pre and post (native units by place in keys),
pre_tokens and post_tokens (at: place in keys, owner, mint, units, decimals) and transfers (source, destination, units;
null where instructions can't be read).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import absence as A

NATIVE, WRAPPED, NATIVE_DECIMALS = "native", "wrapped", 9


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)).cast("long"))


def _change(at: Column) -> Column:
    """What an account's native balance gained; the place counts from 0."""
    return F.get("post", at) - F.get("pre", at)


def _moves() -> Column:
    """The party's token balances after (+) and before (-), each with its account."""
    own = lambda c, sign: F.transform(
        F.filter(F.coalesce(F.col(c), F.array().cast("array<struct<at: int, owner: string, mint: string, units: long, decimals: int>>")), lambda x: x["owner"].eqNullSafe(F.col("party"))),
        lambda x: F.struct(x["at"].alias("at"), x["mint"].alias("mint"), (x["units"] * sign).alias("units"), x["decimals"].alias("decimals")),
    )
    return F.concat(own("post_tokens", 1), own("pre_tokens", -1))


def decoded(transactions: DataFrame, registry: list[str]) -> DataFrame:
    """``transactions`` with native, rent, tip, tip_attempted, input, output (absent or known, see ``absence``), their mints and decimals, and ``refusal``.

    The tip is what accounts of the ``registry`` gained, as an instruction only says what was asked for; where balances are
    missing it is what was asked for. The native leg is the party's gain with fee, tip and rent added back and wrapped units folded
    in. Input and output are told only where exactly one asset fell and one rose. Repeated rows are decoded each; a
    transaction without a party or without its accounts is refused.
    """
    usable = F.coalesce((F.size("pre") == F.size("keys")) & (F.size("post") == F.size("keys")), F.lit(False))
    ok, readable = F.col("error").isNull(), F.col("transfers").isNotNull()
    tips = F.array(*[F.lit(x) for x in registry]) if registry else F.array().cast("array<string>")
    rows = transactions.withColumn("_moves", _moves()).withColumn("_place", F.array_position("keys", F.col("party")).cast("int") - 1)
    accounts = F.array_distinct(F.transform("_moves", lambda x: x["at"]))
    wrapped = _total(F.transform(F.filter("_moves", lambda x: x["mint"] == WRAPPED), lambda x: x["units"]))
    rent = A.maybe(F.when(usable, _total(F.transform(accounts, _change)) - wrapped), F.lit("not_reconstructable"))

    asked = lambda keep: _total(F.transform(F.filter("transfers", keep), lambda x: x["units"]))
    to_tip = lambda x: F.array_contains(tips, x["destination"])
    attempted = A.maybe(F.when(readable, asked(to_tip)), F.lit("not_provided"))
    gained = _total(F.transform(F.sequence(F.lit(0), F.size("keys") - 1), lambda i: F.when(F.array_contains(tips, F.get("keys", i)), F.greatest(_change(i), F.lit(0)))))
    tip = A.maybe(F.when(usable, gained).when(readable, asked(to_tip)), F.lit("not_reconstructable"))

    own = F.array_append(F.transform(accounts, lambda i: F.get("keys", i)), F.col("party"))
    tipped = F.when(ok & readable, asked(lambda x: to_tip(x) & F.array_contains(own, x["source"]))).otherwise(0)
    pays = F.col("_place") == 0
    gain = F.when(F.col("_place") >= 0, _change(F.col("_place"))).otherwise(0)
    native = F.when(usable & ~(pays & F.col("fee").isNull()), gain + F.when(pays, F.col("fee")).otherwise(0) + tipped + rent["value"] + wrapped)

    mints = F.array_distinct(F.transform(F.filter("_moves", lambda x: x["mint"] != WRAPPED), lambda x: x["mint"]))
    leg = lambda m: F.struct(m.alias("mint"), _total(F.transform(F.filter("_moves", lambda x: x["mint"] == m), lambda x: x["units"])).alias("units"), F.array_max(F.transform(F.filter("_moves", lambda x: x["mint"] == m), lambda x: x["decimals"])).alias("decimals"))
    rows = rows.withColumn("native", A.maybe(native, F.lit("not_reconstructable"))).withColumns({"rent": rent, "tip": tip, "tip_attempted": attempted})
    of_native = F.array(F.struct(F.lit(NATIVE).alias("mint"), F.coalesce("native.value", F.lit(0).cast("long")).alias("units"), F.lit(NATIVE_DECIMALS).alias("decimals")))
    rows = rows.withColumn("_legs", F.filter(F.concat(F.transform(mints, leg), of_native), lambda x: x["units"] != 0))
    fell, rose = F.filter("_legs", lambda x: x["units"] < 0), F.filter("_legs", lambda x: x["units"] > 0)
    refusal = (
        F.when(F.col("party").isNull() | F.col("keys").isNull(), "no_party").when(~ok, "transaction_failed").when(F.col("pre_tokens").isNull() | F.col("post_tokens").isNull(), "not_provided")
        .when((F.size(fell) != 1) | (F.size(rose) != 1), "not_reconstructable")
    )
    rows = rows.withColumn("refusal", refusal)
    side = lambda legs, name: {name: A.maybe(F.when(F.col("refusal").isNull(), F.abs(F.get(legs, F.lit(0))["units"])), F.col("refusal")), **{f"{name}_{f}": F.when(F.col("refusal").isNull(), F.get(legs, F.lit(0))[f]) for f in ("mint", "decimals")}}
    return rows.withColumns(side(fell, "input") | side(rose, "output")).drop("_moves", "_place", "_legs")


def price() -> Column:
    """Output per input in whole coins; null where a leg or its scale isn't known."""
    coins = lambda side: F.col(f"{side}.value") / F.pow(F.lit(10.0), F.col(f"{side}_decimals"))
    return F.try_divide(coins("output"), coins("input"))


def linked(fills: DataFrame, quotes: DataFrame) -> DataFrame:
    """Decoded ``fills`` (with decision) linked to ``quotes`` (decision, quoted_input, input_mint, quoted_output, output_mint, least_output, quoted_price) by decision only; nearness in time never links.

    ``refusals`` lists what speaks against a link: no_decision, no_quote, input_mint_mismatch, output_mint_mismatch and
    min_output_breach, a fill below the floor of its quote. Without refusals there are slippage (positive: worse than
    quoted), fill_ratio and partial. A decision that several quotes name is refused, as ambiguous_quote.
    """
    known = quotes.where("decision is not null").groupBy("decision").agg(F.count("*").alias("_quotes"), *[F.min(c).alias(f"q_{c}") for c in quotes.columns if c != "decision"])
    rows = fills.join(known, "decision", "left")
    differ = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    breach = F.coalesce((F.col("q_output_mint") == F.col("output_mint")) & (F.col("output.value") < F.col("q_least_output")), F.lit(False))
    reasons = [
        (F.col("decision").isNull(), "no_decision"), (F.col("decision").isNotNull() & F.col("_quotes").isNull(), "no_quote"), (F.coalesce(F.col("_quotes") > 1, F.lit(False)), "ambiguous_quote"),
        (differ("q_input_mint", "input_mint"), "input_mint_mismatch"), (differ("q_output_mint", "output_mint"), "output_mint_mismatch"), (breach, "min_output_breach"),
    ]
    rows = rows.withColumn("refusals", F.filter(F.array(*[F.when(c, n) for c, n in reasons]), lambda x: x.isNotNull()))
    holds = F.size("refusals") == 0
    ratio = F.when(holds, F.try_divide(F.col("input.value").cast("double"), F.col("q_quoted_input").cast("double")))
    slip = F.when(holds, F.try_divide(F.col("q_quoted_price") - price(), F.col("q_quoted_price")))
    return rows.withColumns({"linked": holds, "slippage": slip, "fill_ratio": ratio, "partial": ratio < 1}).drop("_quotes", *[f"q_{c}" for c in quotes.columns if c != "decision"])
