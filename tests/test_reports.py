"""Readings of reports on rows made for them."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import reports

WEEK = "period int, scored long, ece double, prevalence double, brier double, top_share double, label string"


def weeks(spark, rows):
    return spark.createDataFrame([(i, 20 if ok else 3, e, p, 0.2, s, "measured" if ok else "too_thin") for i, (e, p, s, ok) in enumerate(rows)], WEEK)


@pytest.mark.parametrize(("rows", "label"), [
    ([], "too_thin_for_trend"),
    ([(0.1, 0.5, 0.3, True)] * 3, "too_thin_for_trend"),
    ([(0.1, 0.5, 0.3, True)] * 3 + [(0.9, 0.9, 0.9, False)] * 5, "too_thin_for_trend"),
    ([(0.1, 0.5, 0.3, True)] * 4, "reliability_stable"),
    ([(0.2, 0.5, 0.3, True)] * 2 + [(0.1, 0.5, 0.3, True)] * 2, "reliability_improving"),
    ([(0.1, 0.5, 0.3, True)] * 2 + [(0.2, 0.5, 0.3, True)] * 2, "reliability_deteriorating"),
    ([(0.1, 0.5, 0.3, True)] * 2 + [(0.2, 0.5, 0.51, True)] * 2, "composition_shift_dominates"),
    ([(0.1, 0.5, 0.3, True)] * 2 + [(0.1, 0.7, 0.3, True)] * 2, "composition_shift_dominates"),
    ([(0.1, 0.5, 0.3, True), (9.0, 0.0, 1.0, False)] * 4, "reliability_stable"),
])
def test_trend(spark, rows, label):
    out = reports.trend(weeks(spark, rows)).collect()
    assert [r["label"] for r in out] == [label]


def test_periods_of_odd_rows(spark):
    rows = [(1, "a", 500, 1)] * 10 + [(1, "b", 0, 0)] * 5 + [(2, "a", 1000, 1), (2, "a", 1000, 1), (None, "a", 0, 1)]
    got = {r["period"]: (r["scored"], r["ece"], r["prevalence"], r["top_share"], r["label"]) for r in reports.periods(spark.createDataFrame(rows, "period int, domain string, p long, y long")).collect()}
    assert got[1] == (15, round(5 / 15, 6), round(10 / 15, 6), round(10 / 15, 6), "measured")
    assert got[2] == (2, 0.0, 1.0, 1.0, "too_thin")
    assert reports.periods(spark.createDataFrame([], "period int, domain string, p long, y long")).count() == 0


@pytest.mark.parametrize(("n", "toward", "frictionless", "fees", "touch", "ticker", "game", "label"), [
    (11, 0.9, 1.0, 1.0, 1.0, 0.1, 0.1, "too_thin"), (80, 0.6, 0.2, 0.1, 0.1, 0.1, 0.1, "promising_friction_adjusted_shadow"), (80, 0.6, 0.2, 0.1, 0.1, 0.4, 0.1, "neutral"), (74, 0.6, 0.2, 0.1, 0.1, 0.1, 0.1, "neutral"),
    (80, 0.6, 0.2, -0.1, None, 0.1, 0.1, "cost_killed"), (80, 0.6, 0.2, None, 0.0, 0.1, 0.1, "cost_killed"), (80, 0.6, -0.2, -0.3, -0.3, 0.1, 0.1, "neutral"), (80, None, None, None, None, None, None, "neutral"),
])
def test_cost_label(spark, n, toward, frictionless, fees, touch, ticker, game, label):
    lit = lambda x: F.lit(x).cast("double")
    assert spark.range(1).select(reports.cost_label(F.lit(n), *map(lit, (toward, frictionless, fees, touch, ticker, game))).alias("x")).first()["x"] == label


def outcomes(stratum, value, yes, no, unknown=0):
    return [(stratum, value, True)] * yes + [(stratum, value, False)] * no + [(stratum, value, None)] * unknown


@pytest.mark.parametrize(("rows", "label", "diluted"), [
    (outcomes(True, "a", 10, 10) + outcomes(True, "b", 10, 10) + outcomes(False, "a", 10, 10) + outcomes(False, "b", 10, 10), "tape_readable", False),
    (outcomes(True, "a", 20, 0) + outcomes(True, "b", 0, 20) + outcomes(False, "a", 20, 0) + outcomes(False, "b", 2, 18), "consistent_across_sources", False),
    (outcomes(True, "a", 18, 2) + outcomes(True, "b", 2, 18) + outcomes(False, "a", 2, 18) + outcomes(False, "b", 18, 2), "consistent_across_sources", True),
    (outcomes(True, "a", 12, 8) + outcomes(True, "b", 8, 12) + outcomes(False, "a", 400, 400) + outcomes(False, "b", 400, 400), "all_window_diluted", True),
    (outcomes(True, "a", 20, 0) + outcomes(True, "b", 0, 20) + outcomes(None, "a", 1, 1), "tape_only_hint", False),
    (outcomes(True, "a", 3, 3) + outcomes(False, "a", 20, 0) + outcomes(False, "b", 0, 20), "derived_only_dominates", False),
    (outcomes(True, "a", 3, 3), "tape_too_thin", False),
    (outcomes(True, "a", 10, 10) + outcomes(True, "b", 10, 10) + outcomes(False, "a", 20, 0) + outcomes(False, None, 0, 20), "derived_only_dominates", False),
    (outcomes(True, "a", 10, 0, 90) + outcomes(True, "b", 0, 10, 90), "tape_too_thin", False),
])
def test_strata(spark, rows, label, diluted):
    r = reports.stratified_separation(spark.createDataFrame(rows, "taped boolean, v string, good boolean"), ["v"]).first()
    assert (r["source_label"], r["diluted"]) == (label, diluted)


def test_no_rows(spark):
    assert reports.stratified_separation(spark.createDataFrame([], "taped boolean, v string, good boolean"), ["v"]).count() == 0


TOKEN = {"liquidity": 60_000.0, "volume": 150_000.0, "top10": 10, "sniper": 5, "insider": 5, "bundler": 5, "confidence": 0.9, "attention": 0.9, "attention_before": 0.5, "boost": 1, "boost_velocity": 1, "social": True, "catalysts": 3, "profile": 1.0, "age": 100, "liquidity_growth": 0.5, "volume_growth": 0.5, "snapshots": 3, "level": None, "provided": True}
TOKEN |= dict.fromkeys(("rug", "honeypot", "mint_open", "freeze_open", "fake_volume", "removed", "spike", "unknown_provider"), False)
TOKEN_SCHEMA = "liquidity double, volume double, top10 int, sniper int, insider int, bundler int, confidence double, attention double, attention_before double, boost int, boost_velocity int, social boolean, catalysts int, profile double, age int, liquidity_growth double, volume_growth double, snapshots int, level string, provided boolean, rug boolean, honeypot boolean, mint_open boolean, freeze_open boolean, fake_volume boolean, removed boolean, spike boolean, unknown_provider boolean"


@pytest.mark.parametrize(("change", "risk", "priority"), [
    ({}, 0.0, "high_review"), ({"level": "severe"}, 1.0, "reject_risk"), ({"level": "high"}, 0.8, "reject_risk"), ({"level": "medium"}, 0.4, "elevated_review"), ({"rug": True}, 1.0, "reject_risk"), ({"sniper": 21}, 0.7, "monitor"),
    ({"provided": None}, 0.55, "elevated_review"), ({"unknown_provider": True}, 0.2, "high_review"), ({"attention": 0.0, "attention_before": 0.0, "boost": 0, "boost_velocity": 0, "social": False, "catalysts": 0, "profile": 0.0, "age": 10**6, "liquidity_growth": -1.0, "volume_growth": -1.0, "snapshots": 0}, 0.0, "elevated_review"),
    (dict.fromkeys(TOKEN), 0.55, "low"),
])
def test_agents(spark, change, risk, priority):
    from tidemark.functions import agents as A

    rows = spark.createDataFrame([tuple({**TOKEN, **change}.values())], TOKEN_SCHEMA)
    scores = {"structure": A.STRUCTURE, "velocity": A.VELOCITY, "timing": A.TIMING, "coverage": A.COVERAGE}
    rows = rows.withColumns({n: F.expr(a.score()).cast("double") for n, a in scores.items()} | {"risk": F.expr(A.RISK).cast("double")}).withColumn("momentum", F.expr(A.MOMENTUM))
    r = rows.withColumn("priority", F.expr(A.PRIORITY)).first()
    assert (round(r["risk"], 6), r["priority"]) == (risk, priority)
    assert all(0 <= r[n] <= 1 for n in scores)
    if not any(v is not None for v in {**TOKEN, **change}.values()):
        assert [r[n] for n in scores] == [0.3, 0.2, 0.4, 0.0]
