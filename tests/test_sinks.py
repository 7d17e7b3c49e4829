"""Commits that may be repeated or fail half way, and imports of files."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import buckets
from tidemark.sources import imports
from tidemark.streaming import sinks

TICKS = "key long, id long, t long, cents long"


def tick_rows(n=300):
    rng = random.Random(4)
    return [(rng.randrange(4), i, rng.randrange(4 * 86_400) * 1_000_000, rng.choice([None, rng.randrange(100)])) for i in range(n)]


def table_rows(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("key", "bucket", "open", "high", "low", "close", "total", "n").collect())


def whole(spark, rows):
    ticks = spark.createDataFrame(rows, TICKS)
    bars = buckets.ohlc(ticks.where("cents is not null").withColumn("type", F.lit("x")), 3600).select("key", "bucket", "open", "high", "low", "close", F.round(F.col("mean") * F.col("tick_count")).cast("long").alias("total"), F.col("tick_count").alias("n"))
    return sorted(tuple(r) for r in bars.collect())


def test_replayed_and_broken_batches(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "bars"), tick_rows()
    commit = sinks.commit_batch(path, "day", sinks.merge_bars())
    batch = lambda i: sinks.bars_by_day(spark.createDataFrame(rows[100 * i : 100 * i + 100], TICKS), 3600)
    commit(batch(0), 0)
    commit(batch(0), 0)  # replayed
    assert table_rows(spark, path) == whole(spark, rows[:100])
    frame = type(spark.range(0))
    save, calls = frame.write.fget, []

    class Broken(Exception):
        pass

    def failing(df):  # the swap fails after one of the partitions has been replaced
        calls.append(1)
        if len(calls) == 2:
            first = df.select(F.min("day")).first()[0]
            save(df.where(F.col("day") == first)).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
            raise Broken
        return save(df)

    monkeypatch.setattr(frame, "write", property(failing))
    with pytest.raises(Broken):
        commit(batch(1), 1)
    monkeypatch.setattr(frame, "write", property(save))
    assert sinks.committed_batches(spark, path).select("batch").distinct().count() == 1
    commit(batch(1), 1)
    assert table_rows(spark, path) == whole(spark, rows[:200])
    commit(batch(1).limit(0), 2)
    commit(batch(2), 3)
    commit(batch(2), 3)
    assert table_rows(spark, path) == whole(spark, rows)
    assert {r["batch"] for r in sinks.committed_batches(spark, path).collect()} == {0, 1, 2, 3}


def test_stream_into_bars(spark, tmp_path):
    rows = tick_rows()
    for i in range(3):
        spark.createDataFrame(rows[100 * i : 100 * i + 100], TICKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path = str(tmp_path / "bars")
    commit = sinks.commit_batch(path, "day", sinks.merge_bars())
    source = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run with another checkpoint replays all batches
        q = source.writeStream.foreachBatch(lambda df, n: commit(sinks.bars_by_day(df, 3600), n)).option("checkpointLocation", str(tmp_path / f"cp{_}")).start()
        q.processAllAvailable()
        q.stop()
        assert table_rows(spark, path) == whole(spark, rows)


def lines(n, start=0):
    return "".join(json.dumps({"id": start + i, "v": f"x{i}"}) + "\n" for i in range(n)).encode()


def test_import(spark, tmp_path):
    source, target = tmp_path / "old", str(tmp_path / "new")
    (source / "deep").mkdir(parents=True)
    (source / "a.json").write_bytes(lines(3))
    (source / "copy_of_a.json").write_bytes(lines(3))
    (source / "deep/b.json.gz").write_bytes(gzip.compress(lines(4, 10)) + gzip.compress(lines(1, 14)))
    (source / "torn.json.gz").write_bytes(gzip.compress(lines(200, 20))[:-30])
    (source / "tail.json").write_bytes(lines(2, 30) + b'{"id": 32, "v"')
    (source / "bad.json").write_bytes(lines(1, 40) + b"[nothing\n" + lines(1, 41))
    (source / "latin.json").write_bytes(b'{"id": 1, "v": "\xe9"}\n')
    (source / "empty.json").write_bytes(b"")
    schema = "id long, v string"
    dry = {r["file"]: (r["state"], r["records"]) for r in imports.import_files(spark, str(source), target, schema).collect()}
    assert dry["a.json"] == ("would_be_imported", 3) and dry["torn.json.gz"][0] == "would_be_quarantined" and not (tmp_path / "new").exists()
    got = {r["file"]: (r["state"], r["reason"]) for r in imports.import_files(spark, str(source), target, schema, confirm=True).collect()}
    assert got == {
        "a.json": ("imported", None), "b.json.gz": ("imported", None), "torn.json.gz": ("quarantined", "torn"), "tail.json": ("quarantined", "no_last_newline"), "bad.json": ("quarantined", "no_record"),
        "latin.json": ("quarantined", "not_utf8"),
    }
    ids = lambda: sorted(r["id"] for r in spark.read.parquet(f"{target}/records").collect())
    assert ids() == [0, 1, 2, 10, 11, 12, 13, 14]
    assert imports.import_files(spark, str(source), target, schema, confirm=True).count() == 0
    (source / "c.json").write_bytes(lines(2, 50))
    (source / "torn.json.gz").write_bytes(gzip.compress(lines(2, 60)))  # mended: another content
    assert {r["file"] for r in imports.import_files(spark, str(source), target, schema, confirm=True).collect()} == {"c.json", "torn.json.gz"}
    assert ids() == [0, 1, 2, 10, 11, 12, 13, 14, 50, 51, 60, 61]
    with pytest.raises(ValueError, match="overlap"):
        imports.import_files(spark, str(source), str(source / "deep"), schema)


def test_import_takes_up_what_failed(spark, tmp_path, monkeypatch):
    source, target = tmp_path / "old", str(tmp_path / "new")
    source.mkdir()
    (source / "a.json").write_bytes(lines(3))
    frame = type(spark.range(0))
    write = frame.coalesce
    monkeypatch.setattr(frame, "coalesce", lambda *_: (_ for _ in ()).throw(RuntimeError("ledger")))
    with pytest.raises(RuntimeError, match="ledger"):
        imports.import_files(spark, str(source), target, "id long, v string", confirm=True)
    monkeypatch.setattr(frame, "coalesce", write)
    assert imports.ledger(spark, target).count() == 0
    imports.import_files(spark, str(source), target, "id long, v string", confirm=True)
    assert spark.read.parquet(f"{target}/records").count() == 3 and imports.ledger(spark, target).count() == 1
