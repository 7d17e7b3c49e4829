"""Edge rows that the driver tables don't hold: nulls, ties, empties, boundaries."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import absence, codec, gates, scoring, stats, text, tokens, venues
from tidemark.functions import labels as L
from tidemark.operators import asof, buckets, calibration, dedupe, drift, linkage, predicates, ranking, retention, selection, sequences, similarity, windows

TICKS = "key long, id long, t long, cents long, type string"


def ticks(spark, rows):
    return spark.createDataFrame([(k, i, t, c, "x") for k, i, t, c in rows], TICKS)


def one(spark, column, schema="v double", value=None):
    return spark.createDataFrame([(value,)], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("days", "score"), [(None, 0), (0.25, 0), (0.625, 0.5), (1.0, 1), (30.0, 1), (105.0, 0.5), (180.0, 0)])
def test_trapezoid(spark, days, score):
    assert one(spark, scoring.trapezoid(F.col("v")), value=days) == pytest.approx(score)


def test_scores_of_missing_values(spark):
    assert one(spark, scoring.spread_score(F.col("v"))) == 0
    assert one(spark, scoring.spread_score(F.col("v")), value=-1.0) == 0
    assert one(spark, scoring.log_score(F.col("v"), 100)) == 0
    assert one(spark, scoring.log_score(F.col("v"), 100), value=1e9) == 1
    assert one(spark, scoring.mean_of_available([(F.col("v"), 0.5)])) is None
    assert one(spark, scoring.growth(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, scoring.touch_move(F.lit(1.0), F.lit(2.0), F.col("v"), F.lit(4.0), F.lit(1.0))) is None


@pytest.mark.parametrize(("v", "label"), [(None, "no_sample"), (-0.25, "continued_away"), (0.25, "reverted_toward"), (0.0, "flat")])
def test_path_class(spark, v, label):
    assert one(spark, L.path_class(F.col("v")), value=v) == label


@pytest.mark.parametrize(("v", "label"), [(None, "unknown"), (99_999.0, "<100k"), (100_000.0, "100k-1M"), (1e7, ">10M")])
def test_ladder_edges(spark, v, label):
    assert one(spark, L.liquidity_bucket(F.col("v")), value=v) == label


def test_gap_relation(spark):
    cases = [(None, 1.0, "unknown"), (1.0, 0.0, "no_pre_move"), (0.0, 1.0, "no_gap"), (1.0, -1.0, "opposes_move"), (1.0, 1.0, "follows_move")]
    rows = spark.createDataFrame(cases, "g double, m double, want string")
    assert all(r["got"] == r["want"] for r in rows.withColumn("got", L.gap_relation(F.col("g"), F.col("m"))).collect())


@pytest.mark.parametrize(("p", "bin_"), [(0.0, 0), (0.1, 1), (0.29, 2), (0.3, 3), (0.9, 9), (1.0, 9), (None, None), (1.1, None)])
def test_probability_bins(spark, p, bin_):
    assert one(spark, stats.probability_bin(F.col("v"), 10), value=p) == bin_


def test_bins_follow_the_edge_list(spark):
    assert one(spark, stats.probability_bin(F.col("v"), 100), value=0.29) == 29


def test_percentiles_differ(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in range(1, 7)] + [("a", None), ("b", None), (None, 2.0), (None, 2.0)], "k string, v double")
    known = F.col("known")
    ranks = {"rounded": ranking.rounded_rank(known, 0.5), "nearest": ranking.nearest_rank(known, 0.5, 2), "low": F.expr("(known + 1) div 2"), "high": F.expr("known div 2 + 1"), "thin": ranking.nearest_rank(known, 0.5, 20)}
    for width in (1, 4, 1000):  # how values are cut into stretches changes nothing
        got = {r["k"]: r[1:] for r in ranking.at_ranks(ranking.value_counts(rows, ["k"], "v", width), ["k"], "v", ranks).collect()}
        assert got["a"] == (7, 6, 3.0, 3.0, 3.0, 4.0, None)
        assert got["b"][:4] == (1, 0, None, None)
        assert got[None] == (2, 2, 2.0, 2.0, 2.0, 2.0, None)
    assert ranking.at_ranks(ranking.value_counts(rows.limit(0), ["k"], "v", 1), ["k"], "v", ranks).count() == 0


def test_places_of_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 7.5), (3, 7.5), (4, None), (5, -3.0), (6, 7.4)], "id long, v double")
    for width in (0.5, 3, 100):
        assert {r["id"]: r["place"] for r in ranking.placed(rows, "v", "id", width).collect()} == {2: 1, 3: 2, 6: 3, 1: 4, 5: 5, 4: 6}
    assert ranking.placed(rows.limit(0), "v", "id", 1).count() == 0


def test_fixture_links(spark):
    fixtures = [(1, 10, "A", "B"), (2, 11, "C", "D"), (3, 9, "C", "D"), (4, 10, "E", "F"), (5, 10, "F", "E"), (6, 10, "G", "X"), (7, 10, None, "H"), (8, 10, "I", "Y"), (9, 10, "I", "Z"), (10, 30, None, None)]
    markets = {
        "both": (10, "B", "A", ("source_backed_link", "codes_and_day", 1)), "day_after_first": (10, "C", "D", ("source_backed_link", "codes_and_adjacent_day", 2)), "twice": (10, "E", "F", ("fuzzy_candidate", "ambiguous", 4)),
        "one": (10, "G", "Q", ("fuzzy_candidate", "one_code", 6)), "half_a_fixture": (10, "H", "Q", ("provider_no_match", "none", None)), "two_of_one": (10, "I", "Q", ("provider_no_match", "none", None)),
        "one_a_day_off": (11, "G", "Q", ("provider_no_match", "none", None)), "far": (20, "A", "B", ("unresolved", "day_not_fetched", None)), "no_codes": (10, "A", None, ("unresolved", "no_codes", None)),
        "no_day": (None, "A", "B", ("unresolved", "no_date", None)), "fetched_without_codes": (30, "A", "B", ("provider_no_match", "none", None)), "other": (10, "A", "B", ("incompatible_market_type", "other_kind", None)),
    }
    day = F.date_add(F.lit("2026-07-01").cast("date"), F.col("n")).alias("day")
    m = spark.createDataFrame([(k, v[0], v[1], v[2], "total" if k == "other" else "match_winner") for k, v in markets.items()], "id string, n int, a string, b string, kind string").select("id", day, "a", "b", "kind")
    f = spark.createDataFrame(fixtures, "id long, n int, a string, b string").select("id", day, "a", "b")
    assert {r["id"]: (r["label"], r["basis"], r["fixture"]) for r in linkage.link_fixtures(m, f).collect()} == {k: v[3] for k, v in markets.items()}
    assert {r["label"] for r in linkage.link_fixtures(m, f.limit(0)).collect()} == {"unresolved", "incompatible_market_type"}


@pytest.mark.parametrize(("ticker", "spec"), [
    ("KXMLBTOTAL-26JUL082210COLLAD-14", ("total", 13.5, None, None)), ("kxmlbspread-26JUL082210COLLAD-LAD2", ("spread", 1.5, "LAD", True)), ("KXMLBGAME-26JUL082210COLLAD-COL", ("winner", None, "COL", False)),
    ("KXMLBGAME-26JUL082210COLLAD-BOS", ("unknown", None, None, None)), ("KXMLBGAME-26JUL082210NYNY-NY", ("unknown", None, None, None)), ("KXMLBGAME-26ABC082210COLLAD-COL", ("unknown", None, None, None)),
    ("KXMLBTOTAL-26JUL082210COLLAD-O9", ("unknown", None, None, None)), ("", ("unknown", None, None, None)), (None, ("unknown", None, None, None)),
])
def test_game_tickers(spark, ticker, spec):
    got = venues.with_game_spec(spark.createDataFrame([(ticker,)], "ticker string"), "ticker").first()
    assert (got["kind"], got["threshold"], got["team"], got["home"]) == spec


@pytest.mark.parametrize(("ticker", "spec"), [
    ("KXWCTOTAL-26JUN14USAWAL-2.5", ("total", 2.5, None, None)), ("kxwctotal-26JUN141800USAWAL-T3", ("total", 2.5, None, None)), ("KXWCTOTAL-26JUN14USAWAL", ("unknown", None, None, None)), ("KXUCLADVANCE-26JUN14USAWAL-WAL", ("advance", None, "WAL", True)),
    ("KXEPLSPREAD-26JUN14USAWAL-USA2", ("spread", 1.5, "USA", False)), ("KXEPLSPREAD-26JUN14USAWAL-BRA2", ("unknown", None, None, None)), ("KXMLSGOALSCORER-26JUN14USAWAL-USAX9", ("player_goal", None, None, None)), ("KXWCGAME-26JUN14USAWAL-USA", ("winner", None, "USA", False)),
    ("KXWCGAME-26JUN14USAENGL-USA", ("unknown", None, None, None)), ("KXWCGAME-26FOO14USAWAL-USA", ("unknown", None, None, None)), ("KXMLBGAME-26JUN14USAWAL-USA", ("unknown", None, None, None)), ("", ("unknown", None, None, None)), (None, ("unknown", None, None, None)),
])
def test_soccer_tickers(spark, ticker, spec):
    got = venues.with_soccer_spec(spark.createDataFrame([(ticker,)], "ticker string"), "ticker").first()
    assert (got["kind"], got["threshold"], got["team"], got["second_listed"]) == spec


@pytest.mark.parametrize(("ticker", "spec"), [
    ("KXATPMATCH-25MAY26DJOKALC-DJOK", ("winner", "DJOK", True)), ("KXATPMATCH-25MAY26DJOKALC-ALC", ("winner", "ALC", False)), ("kxwtawinner-25MAY261030SWIGAU-gau", ("winner", "GAU", False)), ("KXATPMATCH-25MAY26DJOKALC-XYZ", ("unknown", None, None)),
    ("KXATPMATCH-25MAY26AAAAA-AA", ("unknown", None, None)), ("KXITFSET-25MAY26SWIGAU-SWI", ("unknown", None, None)), ("KXATPMATCH-25MAY26SWIGAU", ("unknown", None, None)), (None, ("unknown", None, None)),
])
def test_tennis_tickers(spark, ticker, spec):
    got = venues.with_tennis_spec(spark.createDataFrame([(ticker,)], "ticker string"), "ticker").first()
    assert (got["kind"], got["player"], got["first_listed"]) == spec


def test_domains(spark):
    assert one(spark, venues.domain(F.lit("kxwta-x"), F.lit("bitcoin"))) == "sports_tennis"
    assert one(spark, venues.domain(F.lit("X-KXMLB"), F.lit("Inflation and the senate"))) == "macro"
    assert one(spark, venues.domain(F.col("v").cast("string"), F.col("v").cast("string"))) == "general"


@pytest.mark.parametrize(("now", "state"), [(800, "pair_detected_not_due"), (950, "pair_ready_for_manual_preparation"), (1000, "shared_due_now_ready"), (1195, "shared_due_now_ready"), (1196, "insufficient_arm_slack"), (1300, "insufficient_arm_slack"), (1301, "expired")])
def test_readiness(spark, now, state):
    second = tokens.SECOND
    assert one(spark, tokens.readiness(F.lit(1000 * second), F.lit(1300 * second), F.lit(now * second), 60 * second)) == state
    assert one(spark, tokens.readiness(F.lit(1000 * second), F.lit(1080 * second), F.lit(1000 * second), 60 * second)) == "insufficient_arm_slack"
    assert one(spark, tokens.readiness(F.lit(1000), F.lit(999), F.lit(now), 0)) == "no_overlapping_pair"


@pytest.mark.parametrize(("role", "n", "toward", "closure", "share", "window", "state"), [
    ("candidate", 11, 0.9, 1.0, 0.1, "validation", "sample_collapsed"), ("candidate", 80, 0.6, 0.1, 0.1, "validation", "validated_shadow"), ("candidate", 80, 0.6, 0.1, 0.1, "mixed", "passes_gates_discovery_only"),
    ("candidate", 80, 0.6, 0.1, 0.35, "validation", "failing_gates"), ("candidate", 80, 0.52, 0.1, 0.1, "validation", "inconclusive_continue_observing"), ("candidate", 40, 0.6, 0.1, 0.1, "validation", "insufficient_sample"),
    ("candidate", 80, None, None, 0.1, "validation", "inconclusive_continue_observing"), ("negative_control", 40, 0.4, 0.1, 0.1, "mixed", "control_consistent"), ("negative_control", 40, 0.6, 0.1, 0.1, "mixed", "control_anomaly"), ("baseline", 0, None, None, 0.1, "mixed", "baseline"),
])
def test_gate_status(spark, role, n, toward, closure, share, window, state):
    as_double = lambda x: F.lit(x).cast("double")
    assert one(spark, gates.status(F.lit(role), F.lit(n), as_double(toward), as_double(closure), F.lit(share), F.lit(0.1), F.lit(window))) == state


def test_wilson_of_nothing(spark):
    low, high = stats.wilson(F.lit(0), F.lit(0))
    assert one(spark, low) is None
    assert one(spark, high) is None


def test_titles(spark):
    assert one(spark, text.normalised_title(F.col("v")), "v string", "Spain vs. Belgium: will   THE\tfinal?") == "spain vs belgium will the final"
    assert one(spark, text.title_tokens(F.col("v")), "v string", None) == []
    assert sorted(one(spark, text.title_tokens(F.col("v")), "v string", "The final versus a FINAL game")) == ["final", "game"]
    assert one(spark, text.tag_value(F.array(F.lit("a:1"), F.lit("b:2:3")), "b:")) == "2:3"
    assert one(spark, text.tag_value(F.array().cast("array<string>"), "b:")) == "unknown"


@pytest.mark.parametrize("data", [b"", b"\0", b"\0\0a", bytes(range(40))])
def test_base58_round_trip(data):
    assert codec.decode58(codec.encode58(data)) == data


def test_codec_refusals(spark):
    assert codec.decode58("0OIl") is None
    rows = spark.createDataFrame([('{"b":1,"a":[1.5,null]}',), ("{",), ('{"a": NaN}',), (None,)], "v string")
    assert [r["x"] for r in rows.select(codec.canonical_json("v").alias("x")).collect()] == ['{"a":[1.5,null],"b":1}', None, None, None]


def test_last_within_edges(spark):
    m = asof.MINUTE
    t = ticks(spark, [(1, 1, 0, 10), (1, 2, 5 * m, 20), (1, 3, 5 * m, 30), (1, 4, 5 * m + 1, 40), (2, 5, 0, 50)])
    found = asof.last_within(t, ["cents"], {"x": 5 * m, "y": 1}).collect()
    assert {r["id"]: r["x"] and r["x"]["cents"] for r in found} == {1: 30, 2: 40, 3: 40, 4: None, 5: None}  # the anchor's own time is out, the deadline is in, the highest id wins
    assert {r["id"]: r["y"] and r["y"]["cents"] for r in found} == {1: None, 2: 40, 3: 40, 4: None, 5: None}


def odd_ticks(spark):
    """Repeated rows, rows of one time, null ids, values, times and keys."""
    m = asof.MINUTE
    return ticks(spark, [(1, 5, 0, 10), (1, 5, 0, 10), (1, None, 0, 11), (1, None, 0, 11), (1, 6, 2 * m, None), (1, 6, 2 * m, 13), (1, 7, 3 * m, 14), (1, 8, None, 15), (None, 1, m, 1), (None, 1, m, 1), (None, 2, 2 * m, 2), (2, 1, 0, 3)])


def rank_of(r):
    return (r["t"], r["id"] is not None, r["id"] or 0)


def test_last_within_keeps_repeated_rows(spark):
    rows = odd_ticks(spark).collect()
    widths = {"short": asof.MINUTE, "long": 3 * asof.MINUTE}
    got = asof.last_within(odd_ticks(spark), ["id"], widths).collect()
    assert sorted(map(str, (r[:5] for r in got))) == sorted(map(str, (tuple(r) for r in rows)))
    for r in got:
        for n, w in widths.items():
            later = [x for x in rows if x["key"] == r["key"] and None not in (x["t"], r["t"]) and r["t"] < x["t"] <= r["t"] + w]
            assert (r[n] and r[n]["id"]) == (max(later, key=rank_of)["id"] if later else None)
            assert (r[n] is None) == (not later)


def test_first_in_lookback_of_repeated_rows(spark):
    rows = odd_ticks(spark).collect()
    got = asof.first_in_lookback(odd_ticks(spark), "cents", "first", 2 * asof.MINUTE).collect()
    assert sorted(map(str, (r[:5] for r in got))) == sorted(map(str, (tuple(r) for r in rows)))
    for r in got:
        back = [x for x in rows if x["key"] == r["key"] and None not in (x["t"], r["t"]) and r["t"] - 2 * asof.MINUTE <= x["t"] <= r["t"]]
        first = min(map(rank_of, back)) if back else None
        assert r["first"] in ({x["cents"] for x in back if rank_of(x) == first} or {None})


def test_peak_rate_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (1, None, 5), (1, 2, 20), (2, 1, None), (None, 1, 3)], "key long, id long, t long")
    assert sorted((tuple(r) for r in windows.peak_rate(rows, ["key"], 10).collect()), key=str) == [(1, 3, 4), (None, 1, 1)]


def test_interval_semi_of_repeated_rows(spark):
    m = asof.MINUTE
    got = asof.interval_semi(odd_ticks(spark).where("key = 1"), odd_ticks(spark), "key", "t", [("two", 2 * m, m), ("none", 50 * m, m)]).collect()
    assert sorted((r["t"], r["horizon"], r["observed"]) for r in got if r["t"] is not None) == [(t, n, n == "two" and t in (0, 2 * m)) for t in (0, 2 * m, 3 * m) for n in ("none", "two")]
    assert not any(r["observed"] for r in got if r["t"] is None)


def test_peak_rate_over_stretches(spark):
    rows = ticks(spark, [(1, i, t, 0) for i, t in enumerate([0, 1, 9, 10, 10, 19, 20, 35])])
    assert [tuple(r) for r in windows.peak_rate(rows, ["key"], 10).collect()] == [(1, 4, 8)]  # 1, 9, 10, 10


def test_asof_modes(spark):
    anchors, t = ticks(spark, [(1, 10, 100, 0), (2, 11, 100, 0), (3, 12, 100, 0)]), ticks(spark, [(1, 1, 100, 5), (1, 2, 100, 6), (1, 3, 120, 9), (2, 4, 50, 7)])
    back = {r["id"]: (r["asof_value"], r["asof_age"]) for r in asof.asof_backward(anchors, t, "key", "t", "id", "cents", 40).collect()}
    assert back == {10: (6, 0), 11: (None, None), 12: (None, None)}
    near = {r["id"]: (r["near_value"], r["near_distance"]) for r in asof.nearest(anchors, t, "key", "t", "id", "cents", 10, 50).collect()}
    assert near == {10: (5, 10), 11: (None, None), 12: (None, None)}  # of two as near the earlier one
    line = {r["id"]: (r["line_value"], r["source"]) for r in asof.interpolated(anchors, t, "key", "t", "id", "cents", 10, 50).collect()}
    assert line == {10: (7.0, "interpolated"), 11: (None, "one_sided"), 12: (None, "one_sided")}


def test_empty_inputs(spark):
    none = ticks(spark, [])
    assert buckets.ohlc(none, 60).count() == 0
    assert windows.cooldown(none, ["key"], 1).count() == 0
    assert asof.asof_backward(none, none, "key", "t", "id", "cents", 1).count() == 0
    assert calibration.errors(calibration.bins(spark.createDataFrame([], "id long, p long, y long"))).first()["ece"] is None


def test_ohlc_skips_rows_without_value(spark):
    r = buckets.ohlc(ticks(spark, [(1, 2, 5, 20), (1, 1, 5, 10), (1, 3, 9, None)]), 60).first()
    assert (r["open"], r["close"], r["tick_count"]) == (10, 20, 2)


def test_streaks(spark):
    rows = ticks(spark, [(1, i, i, c) for i, c in enumerate([1, 1, -1, 0, 1, 1, 1])]).withColumn("s", F.signum("cents").cast("int"))
    assert [r["streak"] for r in windows.streak(rows, "s", 2).orderBy("t").collect()] == [1, 2, 1, 0, 1, 2, 2]


def test_cooldown_counts_from_the_last_that_passed(spark):
    rows = ticks(spark, [(1, i, t * 1_000_000, 0) for i, t in enumerate([0, 5, 9, 10, 12, 19, 21])])
    assert sorted(r["id"] for r in windows.cooldown(rows, ["key"], 10).collect()) == [0, 3, 6]


def test_sequence_verdicts(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([5, 6, 6, 9, 7, None, 10])], "space long, turn long, seq long")
    assert [r["verdict"] for r in sequences.audit(rows, "space", "seq", ["turn"]).orderBy("turn").collect()] == ["ok", "ok", "duplicate", "gap", "regression", "missing", "ok"]


FRAMES = "space long, turn long, market long, generation long, seq long, kind string, levels array<struct<side string, price long, size long>>, side string, price long, change long"


def book_rows(spark):
    """Frames of one space with what must come of each; None: it reaches no book."""
    snap = lambda turn, market, generation, seq, *levels: (1, turn, market, generation, seq, "snapshot", list(levels), None, None, None)
    delta = lambda turn, market, generation, seq, side, price, change: (1, turn, market, generation, seq, "delta", None, side, price, change)
    control = lambda turn, seq, kind="trade": (1, turn, None, 0, seq, kind, None, None, None, None)
    rows = [
        (delta(1, 7, 0, 1, "yes", 40, 5), ("awaiting_rebase", None, None, None)),
        (snap(2, 7, 0, 2, ("yes", 40, 10), ("yes", 38, 4), ("no", 55, 6), ("no", 50, 0)), ("ok", 40, 55, 20)),
        (delta(3, 7, 0, 3, "yes", 40, -10), ("ok", 38, 55, 10)),
        (snap(4, 8, 0, 4), ("ok", None, None, 0)),
        (control(5, 5), None), (control(6, None), None), (control(7, 6, "error"), None),
        (delta(8, 8, 0, 7, "no", 30, 3), ("ok", None, 30, 3)),
        (delta(9, 8, 0, 7, "no", 30, 3), None),  # a redelivery
        (delta(10, 7, 0, 8, "yes", 41, 2), ("ok", 41, 55, 12)),
        (delta(11, 7, 0, 9, "no", 55, -7), ("negative_level", None, None, None)),
        (delta(12, 7, 0, 10, "no", 55, 9), ("negative_level", None, None, None)),
        (delta(13, 8, 0, 11, "no", 31, None), ("delta_rejected", None, None, None)),
        (snap(14, 8, 0, 12, ("no", 31, 4), ("no", 31, 5)), ("snapshot_rejected", None, None, None)),
        (snap(15, 8, 0, 13, ("no", 31, 4)), ("ok", None, 31, 4)),
        (snap(16, 7, 0, 14, ("yes", 1, 1)), ("ok", 1, None, 1)),
        (control(17, 16), None),  # 15 is lost: all books wait for their own snapshots
        (delta(18, 7, 0, 17, "yes", 1, 1), ("awaiting_rebase", None, None, None)),
        (snap(19, 7, 0, 18, ("yes", 2, 2)), ("ok", 2, None, 2)),
        (delta(20, 8, 0, 19, "no", 31, 1), ("awaiting_rebase", None, None, None)),
        (delta(21, 7, 0, 12, "yes", 2, 1), ("awaiting_rebase", None, None, None)),  # falls back
        (snap(22, 7, 0, None, ("yes", 2, 2)), ("ok", 2, None, 2)),  # no number: a fault of the space, but this is a snapshot
        (snap(23, 7, 1, 1, ("yes", 3, 3), ("no", 4, None)), ("snapshot_rejected", None, None, None)),
        (delta(24, 8, 1, 2, "no", 31, 1), ("awaiting_rebase", None, None, None)),
        (snap(25, 8, 1, 3, ("yes", 3, 3)), ("ok", 3, None, 3)),
        (delta(26, 7, 1, 4, "yes", 3, 1), ("snapshot_rejected", None, None, None)),
    ]
    return spark.createDataFrame([r for r, _ in rows], FRAMES), [(r[0], r[2], r[3], r[4], w[0] == "ok", *w) for r, w in rows if w]


@pytest.mark.parametrize(("width", "grace", "margin"), [(20, 2, 3), (20, 0, 0), (7, 1, 0)])
def test_feasible_pairs(spark, width, grace, margin):
    rng = random.Random(width + grace)
    rows = [(rng.choice([1, 2, None]), i, o := rng.randrange(120), rng.choice([None, o - rng.randrange(5), o + rng.randrange(25)])) for i in range(150)] + [(1, 900, None, 3)]
    got = linkage.feasible_pairs(spark.createDataFrame(rows, "g long, id long, open long, ready long").repartition(3), "g", width, grace, margin).collect()
    want = {}
    for g, i, o, p in rows[:-1]:
        others = [r for r in rows[:-1] if r[0] == g and r[1] != i]
        d = o + width - grace - margin
        use = [(max(b[2] - margin, b[3]), b[1]) for b in others if (b[2], b[1]) > (o, i) and p is not None and p <= d and b[3] is not None and b[3] <= d and b[2] + grace <= o + width and b[3] <= b[2] + width - grace - margin]
        want[i] = (sum(abs(b[2] - o) <= width for b in others), len(use), min(use)[1] if use else None)
    assert {r["id"]: (r["overlapping"], r["usable"], r["partner"]) for r in got} == want
    assert linkage.feasible_pairs(spark.createDataFrame([], "g long, id long, open long, ready long"), "g", width, grace, margin).count() == 0


def family(spark):
    grand = spark.createDataFrame([(1, "old", False), (2, "old", True), (3, "new", False), (4, "old", False), (5, None, None)], "id long, age string, safe boolean")
    parents = spark.createDataFrame([(10, 1, "old", False), (11, 1, "new", False), (12, 2, "old", False), (13, 4, "old", False), (14, None, "old", None), (15, 99, "old", False), (11, 1, "new", False)], "id long, of long, age string, safe boolean")
    children = spark.createDataFrame([(100, 10, "new", False), (101, 11, "old", False), (102, 12, "old", True), (103, 13, "new", True), (104, 14, "old", None), (105, None, "new", False)], "id long, of long, age string, safe boolean")
    old, safe = F.col("age") == "old", F.col("safe")
    policies = {"grand": retention.Policy(old, safe), "child": retention.Policy(old, safe, "parent", "of", "id"), "parent": retention.Policy(old, safe, "grand", "of", "id")}
    return {"grand": grand, "parent": parents, "child": children}, policies


FATES = {
    "grand": [(1, "deleted"), (2, "kept_protected"), (3, "kept"), (4, "kept_for_child"), (5, "kept")],
    "parent": [(10, "deleted"), (11, "cascaded"), (11, "cascaded"), (12, "kept_for_child"), (13, "kept_for_child"), (14, "deleted"), (15, "deleted")],
    "child": [(100, "cascaded"), (101, "deleted"), (102, "kept_protected"), (103, "kept"), (104, "deleted"), (105, "kept")],
}


def test_cascade(spark):
    tables_, policies = family(spark)
    fates = retention.cascade(tables_, policies)
    assert list(fates) == ["child", "parent", "grand"]
    assert {n: sorted((r["id"], r["fate"]) for r in df.collect()) for n, df in fates.items()} == FATES
    empty = retention.cascade({n: df.limit(0) for n, df in tables_.items()}, policies)
    assert [r["n"] for r in retention.plan(empty).collect()] == [0, 0, 0]


def test_prune_removes_what_the_plan_says(spark, tmp_path):
    from tidemark.sources import tables

    made, policies = family(spark)
    paths = {n: str(tmp_path / n) for n in made}
    for n, df in made.items():
        df.withColumn("part", F.col("id") % 2).write.partitionBy("part").parquet(paths[n])
    read = lambda: {n: spark.read.parquet(p) for n, p in paths.items()}
    fates = retention.cascade(read(), policies)
    planned = {r["table"]: r["deleted"] + r["cascaded"] for r in retention.plan(fates).collect()}
    paths = {n: paths[n] for n in fates}
    assert tables.prune(spark, paths, fates, dict.fromkeys(paths, "part"), str(tmp_path / "staging")) == planned == {"child": 3, "parent": 5, "grand": 1}
    assert {n: sorted(r["id"] for r in df.collect()) for n, df in read().items()} == {n: [i for i, f in rows if f not in ("deleted", "cascaded")] for n, rows in FATES.items()}
    again = retention.cascade(read(), policies)
    assert tables.prune(spark, paths, again, dict.fromkeys(paths, "part"), str(tmp_path / "again")) == dict.fromkeys(paths, 0)


def test_rotation_reaches_every_row(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([0, 1, None]), rng.choice([None, rng.randrange(1000)])) for i in range(47)]
    df = spark.createDataFrame(rows, "id long, tier int, t long").repartition(3)
    placed = selection.queue_places(df, "tier", "t", "id", 50).cache()
    key = lambda r: (r[1] is None, r[1] or 0, r[2] is None, r[2] or 0, r[0])
    assert [r["id"] for r in placed.orderBy("place").collect()] == [r[0] for r in sorted(rows, key=key)]
    assert [r["place"] for r in placed.orderBy("place").collect()] == list(range(47))
    seen = [[r["id"] for r in selection.rotation(placed, 10, F.lit(c)).orderBy("turn").collect()] for c in range(5)]
    assert all(len(x) == 10 for x in seen) and len({i for x in seen for i in x}) == 47
    assert seen[0] == [r[0] for r in sorted(rows, key=key)][:10]
    assert selection.rotation(placed, 100, F.lit(3)).count() == 47
    assert selection.rotation(placed.limit(0), 10, F.lit(3)).count() == 0


def test_spread_picks_and_gates(spark):
    rng = random.Random(9)
    strata = ["high", "medium", "low"]
    schema = "id long, stratum string, event string, series long, value double, place long"
    for trial in range(3):
        rows = [(i, strata[i // 30], rng.choice([None, *(f"e{k}" for k in range((3, 8, 40)[trial]))]), i % 3, float(100 - i), i + 1) for i in range(90)]
        used, want = set(), set()
        for s in strata:
            own = [r for r in rows if r[1] == s]
            chosen = []
            for r in own:
                event = r[2] or f"row {r[5]}"
                if len(chosen) < 5 and event not in used:
                    chosen.append(r[0])
                    used.add(event)
            want |= set(chosen + [r[0] for r in own if r[0] not in chosen][: 5 - len(chosen)])
        picked = selection.spread_picks(spark.createDataFrame(rows, schema).repartition(4), 5, strata)
        assert {r["id"] for r in picked.collect()} == want
    gates = lambda rows, n=1: selection.gate_failures(spark.createDataFrame(rows, schema), n, strata, 2.0, 3, 2, 1).first()["failures"]
    good = [(1, "high", "a", 1, 40.0, 1), (2, "medium", "b", 2, 20.0, 2), (3, "low", "c", 3, 10.0, 3)]
    assert gates(good) == []
    assert gates(good, 2) == ["stratum_high_not_full", "stratum_medium_not_full", "stratum_low_not_full"]
    assert gates([(1, "high", "a", 1, 20.0, 1), *good[1:]]) == ["high_over_medium_tied"]
    assert gates([(1, "high", "a", 1, 30.0, 1), good[1], (3, "low", "a", 1, 0.0, 3)]) == ["high_over_medium_too_close", "medium_over_low_undefined", "few_events", "one_event_dominates"]
    assert gates([]) == ["stratum_high_not_full", "stratum_medium_not_full", "stratum_low_not_full", "few_events", "few_series"]


def test_drift_of_odd_rows(spark):
    rows = lambda x: spark.createDataFrame(x, "k long, a string, b int, c string")
    pinned = rows([(1, "x", 1, "p"), (2, "x", 1, "p"), (3, None, 1, "p"), (4, "", None, "p"), (5, "x", 1, "p"), (None, "x", 1, "p")])
    live = rows([(1, "x", 1, "q"), (2, "y", None, "p"), (3, "", 1, "p"), (4, "", None, "p"), (6, "x", 1, "p"), (None, "z", 1, "p")])
    got = {r["k"]: (r["state"], r["changed"]) for r in drift.drift(pinned, live, "k", ["b", "a"]).collect()}
    assert got == {1: ("unchanged", []), 2: ("drifted", ["a", "b"]), 3: ("drifted", ["a"]), 4: ("unchanged", []), 5: ("unknown", []), 6: ("unpinned", [])}
    assert drift.drift(pinned.limit(0), live.limit(0), "k", ["a"]).count() == 0


@pytest.mark.parametrize(("title", "rules", "want"), [
    (None, None, (0, "unknown", "needs_manual_review", None, ["missing_rules_text"])), ("x", " \n ", (0, "unknown", "needs_manual_review", None, ["missing_rules_text"])),
    ("x", "Resolves yes according to The Bureau of Records. Else no.", (100, "low", "researchable", "The Bureau of Records", [])),
    ("Likely?", "Resolves by major and widely and generally and seen facts.", (10, "high", "avoid", None, ["subjective_wording:generally", "subjective_wording:likely", "subjective_wording:major", "subjective_wording:widely", "unclear_settlement_source", "multi_condition_phrasing"])),
    ("x", "See stats.bls.gov/cpi for it", (80, "low", "researchable", "stats.bls.gov/cpi", ["rules_text_too_short"])),
    ("x", "unlikelyhood isn't a term, as POSTED by the league office of the day", (100, "low", "researchable", "the league office of the day", [])),
    ("x", "Both of the following: official league results and more words here", (80, "low", "researchable", "official league results and more words here", ["multi_condition_phrasing"])),
])
def test_clarity_of_rules(spark, title, rules, want):
    r = text.with_clarity(spark.createDataFrame([(title, rules)], "title string, rules string"), "title", "rules").first()
    assert (r["points"], r["risk"], r["tradeability"], r["settlement_source"], r["flags"]) == want


def test_book_replay(spark):
    frames, want = book_rows(spark)
    for df in (frames, frames.repartition(3), frames.orderBy(F.desc("turn"))):
        assert sorted(map(tuple, sequences.replay_books(df).collect()), key=str) == sorted(want, key=str)
    assert sequences.replay_books(frames.limit(0)).count() == 0


def test_book_against_plain_levels():
    rng = random.Random(3)
    for _ in range(200):
        book, plain = sequences.Book(), None
        book.begin((0, 0))
        for _ in range(rng.randrange(60)):
            if rng.random() < 0.15:
                levels = {(rng.choice(("yes", "no")), rng.randrange(8)): rng.randrange(4) for _ in range(rng.randrange(6))}
                book.snapshot([(s, p, q) for (s, p), q in levels.items()])
                plain = dict(levels)
            else:
                side, price, change = rng.choice(("yes", "no")), rng.randrange(8), rng.randrange(-2, 4)
                book.delta(side, price, change)
                if plain is not None:
                    left = plain.get((side, price), 0) + change
                    plain = None if left < 0 else plain | {(side, price): left}
            best = lambda side: max((p for (s, p), q in plain.items() if s == side and q), default=None)
            assert book.state()[2:] == ((best("yes"), best("no"), sum(plain.values())) if plain is not None else (None, None, None))


def test_chain(spark):
    rows = spark.createDataFrame([(1, 1, None, "a"), (1, 2, "a", "b"), (1, 3, "x", "c"), (2, 1, None, "a")], "c long, s long, prev string, digest string")
    assert {r["c"]: r["first_broken"] for r in sequences.verify_chain(rows, ["c"], "s", "prev", "digest").collect()} == {1: 3, 2: None}


def test_dedupe_ladder(spark):
    rows = [("d1", "m1", "c1"), ("d1", "m1", "c1"), ("d2", "m1", "c1"), ("d3", "m1", "c2"), ("d4", "m2", "c1"), ("d5", "m3", "c9")]
    df = spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)], "delivery string, message string, content string, t long, id long")
    assert [r["verdict"] for r in dedupe.verdicts(df).orderBy("id").collect()] == ["novel", "redelivery", "restream", "revision", "propagation", "novel"]


def test_predicates(spark):
    rows = spark.createDataFrame([(1, 5.0, "a"), (2, None, "a"), (3, 9.0, None), (4, 9.0, "b")], "id long, v double, s string")
    got = predicates.evaluate(rows, {"all": [{"field": "v", "operator": "gte", "value": 5.0}], "none": [{"field": "s", "operator": "eq", "value": "b"}]})
    assert {r["id"]: (r["member"], r["kept_unknown"]) for r in got.collect()} == {1: (True, 0), 2: (False, 0), 3: (True, 1), 4: (False, 0)}
    for bad in ({"any": []}, {"all": [{"field": "nope", "operator": "eq", "value": 1}]}, {"all": [{"field": "v", "operator": "like", "value": 1}]}, {"all": [{"field": "v", "operator": "in", "value": 1}]}):
        with pytest.raises(predicates.PredicateError):
            predicates.evaluate(rows, bad)


def test_membership_digest_ignores_order_and_repeats(spark):
    a = spark.createDataFrame([(i,) for i in range(100)], "k long")
    b = a.union(a).orderBy(F.desc("k")).repartition(3)
    assert predicates.membership_digest(a, "k").first() == predicates.membership_digest(b, "k").first()
    assert predicates.membership_digest(a, "k").first()["digest"] != predicates.membership_digest(a.where("k < 99"), "k").first()["digest"]


@pytest.mark.parametrize("counted", [0, similarity.COUNTED_TOKENS])
def test_similarity_against_all_pairs(spark, counted, monkeypatch):
    monkeypatch.setattr(similarity, "COUNTED_TOKENS", counted)
    import itertools
    import random

    rng = random.Random(3)
    sets = [[f"w{rng.randrange(25)}" for _ in range(rng.randrange(0, 9))] for _ in range(60)]
    sets = [sorted(set(s)) for s in sets]
    side = lambda k: spark.createDataFrame([(i, s, rng.choice(["a", "b", None])) for i, s in enumerate(sets) if i % 2 == k], "id long, tokens array<string>, domain string")
    left, right = side(0).cache(), side(1).cache()
    want = {}
    for x, y in itertools.product(left.collect(), right.collect()):
        a, b = set(x["tokens"]), set(y["tokens"])
        s = len(a & b) / len(a | b) if a and b else 0
        if s >= 0.3 and (x["domain"] is None or y["domain"] is None or x["domain"] == y["domain"]):
            want[x["id"]] = max(want.get(x["id"], (0, 0)), (s, -y["id"]))
    got = {r["id"]: (r["similarity"], -r["partner"]) for r in similarity.best_partner(left, right, 0.3).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in got)


@pytest.mark.parametrize("counted", [0, similarity.COUNTED_TOKENS])
def test_vetoed_partners_against_all_pairs(spark, counted, monkeypatch):
    monkeypatch.setattr(similarity, "COUNTED_TOKENS", counted)
    import itertools
    import random

    rng = random.Random(4)
    sets = [sorted({f"w{rng.randrange(20)}" for _ in range(rng.randrange(0, 9))}) for _ in range(80)]
    rows = [(i, s, rng.choice(["a", "b", None]), (rng.choice(["x", "y", None]), rng.choice([1, 2, None]))) for i, s in enumerate(sets)]
    frame = lambda x: spark.createDataFrame(x, "id long, tokens array<string>, domain string, facts struct<scope: string, line: int>")
    vetoes = {"scope": lambda a, b: a["scope"] != b["scope"], "line": lambda a, b: a["line"] != b["line"]}
    want = {}
    for (i, s, d, f), (j, t, e, g) in itertools.product(rows[::2], rows[1::2]):
        if not s or not t or (d and e and d != e):
            continue
        score = min(1.0, len({*s} & {*t}) / len({*s} | {*t}) + (0.05 if d and d == e else 0.0))
        why = ",".join(n for n, x, y in zip(("scope", "line"), f, g, strict=True) if x is not None and y is not None and x != y)
        if score >= 0.3:
            want[i] = max(want.get(i, (False, 0.0, 0, "")), (not why, score, -j, why))
    got = {r["id"]: (r["reasons"] == "", r["similarity"], -r["partner"], r["reasons"]) for r in similarity.best_partner(frame(rows[::2]), frame(rows[1::2]), 0.3, 0.05, vetoes).collect()}
    assert got == want
    assert {w[0] for w in want.values()} == {True, False}
    assert similarity.best_partner(frame(rows[:0]), frame(rows), 0.3, 0.05, vetoes).count() == 0


def test_retention_tiers(spark):
    rows = spark.sql("SELECT id, timestamp'2024-01-31 12:00:00' - make_interval(0, 0, 0, CAST(id AS INT)) AS at FROM range(40)")
    got = {r["id"]: r["tiers"] for r in retention.tiers(rows, "at", "id", 2, 2, 2).collect()}
    assert got == {0: "day,month,week", 1: "day", 3: "week", 31: "month"}


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert {(r["k"], r["v"]) for r in buckets.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_cohorts_refuse_other_modes(spark):
    rows = spark.createDataFrame([("LIVE", 1), ("BACKFILL", 2)], "mode string, x int")
    parts = dedupe.by_mode(rows)
    assert {m: [r["x"] for r in dedupe.cohort(p, m).collect()] for m, p in parts.items()} == {"LIVE": [1], "BACKFILL": [2], "PULLED": [], "UNKNOWN": []}
    mixed = [rows, rows.where("mode = 'BACKFILL'"), spark.createDataFrame([(None, 1)], "mode string, x int")]
    for bad in [*[dedupe.cohort(m, "LIVE") for m in mixed], dedupe.by_mode(mixed[2])["LIVE"], dedupe.by_mode(mixed[0].withColumn("mode", F.lit("other")))["LIVE"]]:
        with pytest.raises(Exception, match="mode"):
            bad.collect()
    assert dedupe.permits("LIVE", dedupe.TIMING)
    assert not dedupe.permits("BACKFILL", dedupe.TIMING)
    assert dedupe.permits("BACKFILL", "SOURCE_REPUTATION")


def test_absent_parts_stay_absent(spark):
    part = lambda v, why="gone": absence.maybe(F.lit(v).cast("long"), F.lit(why))
    both = lambda m: tuple(one(spark, m))
    assert both(absence.combined(part(1), part(2))) == (3, None)
    assert both(absence.combined(part(1), part(None, "a"), part(None, "b"))) == (None, "a")
    assert both(absence.residual_fee(part(4999), absence.base_fee(F.lit(1)))) == (None, "conflicting_sources")
    assert both(absence.budget_fee(part(1), part(1))) == (1, None)
    assert both(absence.budget_fee(part(None, "not_provided"), part(None))) == (0, None)
    assert both(absence.reconciled(part(5), part(6))) == (5, None)
    assert both(absence.reconciled(part(5), part(7))) == (None, "conflicting_sources")
    assert both(absence.reconciled(part(None), part(7))) == (7, None)
    assert both(absence.reconciled(part(None, "x"), part(None, "y"))) == (None, "x")


def test_partitions_of_deadlines_grow_with_rows(spark, monkeypatch):
    """A task's sort doesn't grow with the input: with ten rows a task the stream of deadlines spreads further than the session's partitions."""
    from tidemark import session

    monkeypatch.setattr(session, "TASK_ROWS", 10)
    rows = ticks(spark, [(k, i, i * asof.MINUTE, i) for k in range(40) for i in range(5)])
    found = asof.last_within(rows, ["cents"], {"x": asof.MINUTE})
    assert found.rdd.getNumPartitions() == 200 * 2 // 10
    assert {(r["key"], r["id"]): r["x"] and r["x"]["cents"] for r in found.collect()} == {(k, i): i + 1 if i < 4 else None for k in range(40) for i in range(5)}


def test_partitions_of_lines_grow_with_rows(spark, monkeypatch, data):
    """With few rows a task an order's lines spread further than the session's partitions."""
    from tidemark import catalog, session

    monkeypatch.setattr(session, "TASK_ROWS", 500)
    n = spark.read.parquet(f"{data}/lineitem.parquet").count()
    deltas = catalog.queries()["balance_deltas"](spark, data)
    assert deltas.rdd.getNumPartitions() == -(-n // 500) > 4
    assert session.partitions(spark, 1) == 4


def test_counted_similarity_cuts_a_text_once(spark):
    """Each left text's tokens are made once: neither a filter put before the explosion nor a join back makes them anew."""
    left = spark.createDataFrame([(1, "a b c"), (2, "x"), (3, None)], "id long, text string").select("id", F.split("text", " ").alias("tokens"), F.lit(None).cast("string").alias("domain"))
    right = spark.createDataFrame([(7, "a b d"), (8, "y")], "id long, text string").select("id", F.split("text", "[ ]").alias("tokens"), F.lit(None).cast("string").alias("domain"))
    best = similarity.best_partner(left, right, 0.5)
    assert [tuple(r) for r in best.collect()] == [(1, 7, 0.5)]
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "split(" in line and ",  ," in line]
    assert sum("split(" in line and ",  ," in line for line in plan.splitlines()) == 1
