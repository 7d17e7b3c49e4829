"""Landed pages: the data source, whole pulls, and books of both shapes."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import landing, pages


@pytest.fixture
def landed(spark, tmp_path):
    pages.register(spark)
    chains = {"whole": ["c1", "c2", ""], "gone": ["c1", None, "c3", ""], "short": ["c1", "c2"], "early": ["c1", "", ""], "one": [""], "broken": ["c1", "x", ""]}
    for pull, cursors in chains.items():
        for i, cursor in enumerate(cursors):
            if cursor is not None:
                (tmp_path / f"{pull}-{i}.json").write_text(json.dumps({"cursor": cursor, "markets": [{"ticker": f"{pull}{i}", "yes_bid": 40, "yes_ask": 44}]}) if cursor != "x" else "{torn")
    (tmp_path / "notes.txt").write_text("no page")
    return spark.read.format("landed_pages").load(str(tmp_path))


def test_pages(spark, landed):
    assert landed.count() == 15
    assert landed.rdd.getNumPartitions() == 15
    states = {r["pull"]: r["state"] for r in pages.pull_states(landed).collect()}
    assert states == {"whole": "complete", "gone": "page_missing", "short": "cut_short", "early": "ends_before_last", "one": "complete", "broken": "ends_before_last"}
    found = landing.markets(landed.where("pull = 'whole'").select(F.from_json("body", landing.MARKETS).alias("p")).select("p.*"))
    assert sorted(r["ticker"] for r in found.collect()) == ["whole0", "whole1", "whole2"]


def test_pushed_filters(spark, landed):
    reader = pages.PageReader("/nowhere")
    rest = list(reader.pushFilters([pages.EqualTo(("pull",), "whole"), pages.GreaterThan(("number",), 0), pages.EqualTo(("body",), "x")]))
    assert [f.attribute for f in rest] == [("body",)]
    some = landed.where("pull = 'whole' and number > 0")
    assert some.rdd.getNumPartitions() == 2 and sorted(r["number"] for r in some.collect()) == [1, 2]
    assert landed.where("number in (0, 9)").count() == 6
    assert landed.where("pull = 'none'").count() == 0


def test_books_of_both_shapes(spark):
    bodies = [
        {"ticker": "a", "orderbook": {"yes": [[40, 10], [39, 0], [0, 5], [100, 5]], "no": [[55, 1]]}},
        {"ticker": "b", "orderbook_fp": {"yes_dollars": [["0.4025", "10.50"], ["x", "1"], ["0.5"]], "no_dollars": None}},
        {"ticker": "c", "orderbook": {"yes": None, "no": None}}, {"ticker": "d"}, {"ticker": "e", "orderbook": {"yes": [[41, -1], [40, None]]}},
    ]
    text = spark.createDataFrame([(json.dumps(b),) for b in bodies], "body string")
    levels = landing.books(text.select(F.from_json("body", landing.BOOK).alias("p")).select("p.*"))
    got = sorted((r["ticker"], r["side"], r["shape"], r["price"], r["size"], r["valid"]) for r in levels.where("valid").collect())
    assert got == [("a", "no", "cents", 5500, 100, True), ("a", "yes", "cents", 3900, 0, True), ("a", "yes", "cents", 4000, 1000, True), ("b", "yes", "dollars", 4025, 1050, True)]
    tops = {r["ticker"]: tuple(r)[1:] for r in landing.tops(levels).collect()}
    assert tops == {"a": (4000, 5500, 4500, 500, 1100, 2), "b": (4025, None, None, None, 1050, 2), "e": (None, None, None, None, 0, 2)}
