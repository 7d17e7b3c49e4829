"""Streams against their batch forms."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import book_rows, ticks

from tidemark.operators import buckets, dedupe, sequences, windows
from tidemark.streaming import stateful
from tidemark.streaming import windows as stream_windows


def played(spark, tmp_path, frames, make, name, mode="append"):
    """Runs a stream over the frames' Parquet files, one file per trigger, and returns its rows."""
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = make(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def test_ohlc_stream(spark, tmp_path):
    rows = ticks(spark, [(k, i, (i * 17 + k) * 1_000_000, (i * 7919) % 100) for i in range(60) for k in (1, 2)])
    closer = ticks(spark, [(9, 9999, 10_000 * 1_000_000, 1)])
    timed = lambda f: f.withColumn("ts", F.timestamp_micros("t"))
    got = played(spark, tmp_path, [timed(rows), timed(closer)], lambda s: stream_windows.ohlc_stream(s, 60, "1 second"), "ohlc")
    want = {(r["key"], r["bucket"] // 1_000_000): (r["open"], r["high"], r["low"], r["close"], r["tick_count"]) for r in buckets.ohlc(rows, 60).collect()}
    assert {(g[0], int(g[1].timestamp()) if g[1].tzinfo else int((g[1] - __import__("datetime").datetime(1970, 1, 1)).total_seconds())): g[2:] for g in got} == want


def test_cooldown_stream(spark, tmp_path):
    rows = ticks(spark, [(k, 10 * i + k, (i * i % 97) * 1_000_000, 0) for i in range(40) for k in (1, 2)])
    first, second = rows.where("t < 50000000"), rows.where("t >= 50000000")
    got = played(spark, tmp_path, [first, second], lambda s: stateful.cooldown_stream(s, ["key"], 10), "cooldown")
    want = [tuple(r) for r in windows.cooldown(rows, ["key"], 10).collect()]
    # rows of one time may stand for each other
    assert sorted((r[0], r[2]) for r in got) == sorted((r[0], r[2]) for r in want)


def test_sequence_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([5, 6, 6, 9, 7, None, 10])], "space long, turn long, seq long")
    got = played(spark, tmp_path, [rows.where("turn < 3"), rows.where("turn >= 3")], stateful.sequence_stream, "sequence")
    want = sequences.audit(rows, "space", "seq", ["turn"]).select("space", "turn", "last_seq", "verdict")
    assert sorted(got) == sorted(tuple(r) for r in want.collect())


def test_book_stream(spark, tmp_path):
    frames, want = book_rows(spark)
    got = played(spark, tmp_path, [frames.where("turn < 9"), frames.where("turn between 9 and 18"), frames.where("turn > 18")], stateful.book_stream, "book")
    assert sorted(got, key=str) == sorted(want, key=str) == sorted((tuple(r) for r in sequences.replay_books(frames).collect()), key=str)


@pytest.mark.parametrize("late", ["10 seconds"])
def test_redeliveries(spark, tmp_path, late):
    rows = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 3)], "delivery string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r[0] for r in played(spark, tmp_path, [rows], lambda s: stream_windows.redeliveries_dropped(s, late), "redelivery")) == ["d1", "d2"]


@pytest.mark.parametrize("retention", [10**12, 40_000_000])
def test_ledgers_over_shuffled_batches(spark, tmp_path, retention):
    rng = random.Random(retention % 97)
    second = 1_000_000
    rows = [(i, i * second + rng.randrange(3), rng.choice([None, f"d{rng.randrange(60)}"]), f"m{rng.randrange(40)}", rng.choice([None, f"c{rng.randrange(25)}"])) for i in range(120)]
    rows += [(1000 + i, 60 * second, f"d{i}", "m1", "c1") for i in range(3)]  # ties
    schema = "id long, t long, delivery string, message string, content string"
    dealt = sorted(rows, key=lambda r: r[1] + rng.randrange(-9, 9) * second)  # out of order, within the lateness
    closer = [(9999, 10**6 * second, None, None, None)]
    frames = [spark.createDataFrame(dealt[i : i + 30], schema) for i in range(0, len(dealt), 30)] + [spark.createDataFrame(closer, schema)]
    evidence = spark.createDataFrame(played(spark, tmp_path, frames, lambda s: stateful.ledger_stream(s, "30 seconds", retention), "ledger"), stateful.EVIDENCE)
    want = {r["id"]: r["verdict"] for r in dedupe.verdicts(spark.createDataFrame(rows, schema), retention).collect()}
    assert {r["id"]: r["verdict"] for r in dedupe.from_ledgers(evidence).collect()} == want
    assert len(set(want.values())) == 5
    forgotten = {(r["kind"], r["key"]): r["n"] for r in evidence.where("id is null").groupBy("kind", "key").agg(F.count("*").alias("n")).collect()}
    if retention > 10**9:
        assert not forgotten
    else:  # each key once after its last row, and once per longer pause
        times = sorted((r for r in rows if r[3] == "m7"), key=lambda r: r[1])
        pauses = sum(b[1] - a[1] >= retention for a, b in zip(times, times[1:], strict=False))
        assert forgotten["message", "=m7"] == pauses + 1
