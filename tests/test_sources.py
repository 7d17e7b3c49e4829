"""Readers and writers on small files."""

import hashlib
import json

from pyspark.sql import functions as F

from tidemark.sources import landing, tables


def test_market_pages(spark, tmp_path):
    page = {"cursor": "x", "markets": [{"ticker": "A-1", "yes_bid": 40, "yes_ask": 44, "volume_24h": 5}, {"ticker": "B-1", "yes_bid_dollars": "0.3700", "yes_ask_dollars": "0.0000"}]}
    (tmp_path / "a.json").write_text(json.dumps(page))
    (tmp_path / "b.json").write_text("{not json")
    good, bad = landing.read_pages(spark, str(tmp_path), landing.MARKETS)
    got = {r["ticker"]: (r["yes_bid"], r["yes_ask"], r["midpoint"]) for r in landing.markets(good).collect()}
    assert got == {"A-1": (40, 44, 0.42), "B-1": (37, None, None)}
    assert [r["text"] for r in bad.collect()] == ["{not json"]


def test_catalog_and_pairs(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.json").write_text(json.dumps({"id": "1", "question": "q", "outcomes": '["Yes","No"]', "outcomePrices": '["0.4","0.6"]', "bestBid": 0.39}))
    r = landing.catalog(landing.read_pages(spark, str(tmp_path / "c"), landing.CATALOG)[0]).first()
    assert (r["outcomes"], r["outcome_prices"]) == (["Yes", "No"], [0.4, 0.6])
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.json").write_text(json.dumps({"pairs": [{"chainId": "s", "baseToken": {"address": "t"}, "priceUsd": "1.5", "liquidity": {"usd": 9.0}}]}))
    r = landing.pairs(landing.read_pages(spark, str(tmp_path / "p"), landing.PAIRS)[0]).first()
    assert (r["token_address"], r["price_usd"], r["liquidity_usd"]) == ("t", 1.5, 9.0)


def test_upsert_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 2)], "k long, v string, p int").write.partitionBy("p").parquet(path)
    new = spark.createDataFrame([(2, "B", 1), (4, "d", 1)], "k long, v string, p int")
    for n in range(2):  # a rerun changes nothing
        tables.upsert_partitions(spark, path, new, ["k"], "p", str(tmp_path / f"staging{n}"))
        assert {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "B"), (3, "c"), (4, "d")}
    stats = tables.file_statistics(spark, path).first()
    assert stats["n"] == 4
    assert stats["bytes"] > 0


def test_validation_and_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id long, n int")
    got = {r["id"]: r["invalid"] for r in tables.validated(rows, {"n": F.col("n") >= 0}).collect()}
    assert got == {1: [], 2: ["n"], 3: ["n"]}
    tables.append_lines(rows, str(tmp_path / "l"))
    tables.append_lines(rows, str(tmp_path / "l"))
    assert tables.read_json_lines(spark, str(tmp_path / "l"), "id long, n int").count() == 6


def test_checksums_and_fixtures(spark, tmp_path):
    rows = spark.range(50).withColumn("v", F.col("id") * 2)
    assert sorted(tables.checksums(rows, ["id", "v"]).collect()) == sorted(tables.checksums(rows.orderBy(F.desc("id")), ["id", "v"]).collect())
    (tmp_path / "a.bin").write_bytes(b"one")
    (tmp_path / "b.bin").write_bytes(b"two")
    expected = spark.createDataFrame([("a.bin", hashlib.sha256(b"one").hexdigest()), ("b.bin", "0"), ("c.bin", "0")], "file string, sha256 string")
    assert {r["file"]: r["state"] for r in tables.fixtures(spark, str(tmp_path), expected).collect()} == {"a.bin": "ok", "b.bin": "changed", "c.bin": "missing"}
