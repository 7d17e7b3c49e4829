"""Decoded transactions and their links, on rows that the driver tables don't hold."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fills

TOKEN = "array<struct<at: int, owner: string, mint: string, units: long, decimals: int>>"
TX = f"signature string, party string, decision string, error string, fee long, keys array<string>, pre array<long>, post array<long>, pre_tokens {TOKEN}, post_tokens {TOKEN}, transfers array<struct<source: string, destination: string, units: long>>"
BASE = {
    "signature": "s", "party": "me", "decision": "d1", "error": None, "fee": 5000, "keys": ["me", "acct", "tip"], "pre": [1_000_000, 2039, 0], "post": [1_000_000 - 5000 - 300 - 10_000, 2039, 300],
    "pre_tokens": [(1, "me", "m", 5, 2)], "post_tokens": [(1, "me", "m", 105, 2)], "transfers": [("me", "tip", 300)],
}


def one(spark, **change):
    row = {**BASE, **change}
    return fills.decoded(spark.createDataFrame([tuple(row[c.split()[0]] for c in ("signature", "party", "decision", "error", "fee", "keys", "pre", "post", "pre_tokens", "post_tokens", "transfers"))], TX), ["tip", "tip2"])


@pytest.mark.parametrize(("change", "native", "tip", "input_", "output", "refusal"), [
    ({}, -10_000, 300, ("native", 10_000), ("m", 100), None),
    ({"transfers": None}, -10_300, 300, ("native", 10_300), ("m", 100), None),  # no tip can be seen leaving the party
    ({"transfers": [("me", "tip", 900)]}, -9_400, 300, ("native", 9_400), ("m", 100), None),  # the tip is what arrived
    ({"fee": None}, None, 300, None, None, "not_reconstructable"),
    ({"error": "x", "post": [995_000, 2039, 0], "post_tokens": [(1, "me", "m", 5, 2)]}, 0, 0, None, None, "transaction_failed"),
    ({"pre_tokens": None, "post_tokens": None}, -10_000, 300, None, None, "not_provided"),
    ({"post": [1, 2]}, None, 300, None, None, "not_reconstructable"),
    ({"post": None, "transfers": None}, None, None, None, None, "not_reconstructable"),
    ({"post_tokens": [(1, "me", "m", 105, 2), (1, "me", "n", 1, 0)]}, -10_000, 300, None, None, "not_reconstructable"),
    ({"post_tokens": [(1, None, "m", 105, 2)], "pre_tokens": []}, -10_000, 300, None, None, "not_reconstructable"),
    ({"pre_tokens": [(1, "me", "wrapped", 20_000, 9)], "pre": [1_000_000, 22_039, 0], "post": [994_700, 2039, 300], "post_tokens": [(1, "me", "wrapped", 0, 9), (3, "me", "m", 7, 0)]}, -20_000, 300, ("native", 20_000), ("m", 7), None),
    ({"keys": ["relay", "me", "tip"], "pre": [9, 10_000, 0], "post": [4, 4_000, 0], "transfers": [], "pre_tokens": [(7, "me", "m", 0, 2)], "post_tokens": [(7, "me", "m", 9, 2)], "fee": None}, -6_000, 0, ("native", 6_000), ("m", 9), None),
    ({"party": None}, None, 300, None, None, "no_party"),
    ({"keys": None}, None, 300, None, None, "no_party"),
])
def test_decoding(spark, change, native, tip, input_, output, refusal):
    r = one(spark, **change).first()
    if change.get("party", 1) is not None:
        assert r["native"]["value"] == native
    assert r["tip"]["value"] == tip
    side = lambda s: None if r[f"{s}_mint"] is None else (r[f"{s}_mint"], r[s]["value"])
    assert (side("input"), side("output"), r["refusal"]) == (input_, output, refusal)
    assert (r["input"]["reason"] is None) == (refusal is None)


QUOTE = "decision string, quoted_input long, input_mint string, quoted_output long, output_mint string, least_output long, quoted_price double"


@pytest.mark.parametrize(("quotes", "change", "refusals", "partial"), [
    ([("d1", 20_000, "native", 100, "m", 90, 1e5)], {}, [], True),
    ([("d1", 10_000, "native", 100, "m", None, 1e5)], {}, [], False),
    ([("d1", 10_000, "other", 100, "other", 500, 1e5)], {}, ["input_mint_mismatch", "output_mint_mismatch"], None),
    ([("d1", 10_000, "native", 100, "m", 101, 1e5)], {}, ["min_output_breach"], None),
    ([("d2", 10_000, "native", 100, "m", 1, 1e5)], {}, ["no_quote"], None),
    ([("d1", 10_000, "native", 100, "m", 1, 1e5)], {"decision": None}, ["no_decision"], None),
    ([(None, 10_000, "native", 100, "m", 1, 1e5)], {"decision": None}, ["no_decision"], None),
    ([("d1", 10_000, "native", 100, "m", 1, 1e5), ("d1", 9_000, "native", 100, "m", 1, 1e5)], {}, ["ambiguous_quote"], None),
    ([], {}, ["no_quote"], None),
])
def test_links(spark, quotes, change, refusals, partial):
    r = fills.linked(one(spark, **change), spark.createDataFrame(quotes, QUOTE)).first()
    assert (r["refusals"], r["linked"], r["partial"]) == (refusals, not refusals, partial)
    assert (r["slippage"] is None) == bool(refusals)
    if not refusals:
        assert r["slippage"] == pytest.approx((1e5 - (100 / 100) / (10_000 / 1e9)) / 1e5)


def test_repeated_and_no_transactions(spark):
    twice = one(spark).unionByName(one(spark))
    assert fills.linked(twice, spark.createDataFrame([("d1", 1, "native", 1, "m", 1, 1.0)], QUOTE)).where("linked").count() == 2
    assert one(spark).where(F.lit(False)).count() == 0
