"""Sealed segments: cuts, digests, trees, and what a check finds."""

import gzip
import hashlib
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chains
from tidemark.sources import segments

RECORD = "segment string, ordinal long, content string"


def sealed_by_hand(rows):
    out = {}
    for s in {r[0] for r in rows}:
        prev = hashlib.sha256(f"genesis\n{s}".encode()).hexdigest()
        for _, o, c in sorted(r for r in rows if r[0] == s):
            digest = hashlib.sha256(f"{s}\n{o}\n{prev}\n{'-' if c is None else '+' + c}".encode()).hexdigest()
            out[s, o] = (prev, digest)
            prev = digest
    return out


def records(spark, n=10, segments_=("a", "b")):
    return [(s, i, None if i == 3 else "" if i == 4 else f"{s}{i}") for s in segments_ for i in range(n)]


def test_sealing(spark):
    rows = records(spark)
    got = {(r["segment"], r["ordinal"]): (r["prev"], r["digest"]) for r in chains.sealed(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == sealed_by_hand(rows)
    assert chains.sealed(spark.createDataFrame([], RECORD)).count() == 0
    with pytest.raises(Exception, match="no segment or ordinal"):
        chains.sealed(spark.createDataFrame([("a", None, "x")], RECORD)).collect()


def tree(digests, levels, fanout):
    nodes = dict(enumerate(digests))
    for _ in range(levels):
        runs = {}
        for at in sorted(nodes):
            runs.setdefault(at // fanout, []).append(nodes[at])
        nodes = {k: hashlib.sha256(":".join(v).encode()).hexdigest() for k, v in runs.items()}
    return nodes[0]


@pytest.mark.parametrize(("n", "fanout"), [(1, 4), (4, 4), (5, 4), (50, 4), (50, 100)])
def test_roots(spark, n, fanout):
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    df = spark.createDataFrame([("k", i, d) for i, d in enumerate(digests)], "k string, at long, digest string").repartition(3)
    assert chains.roots(df, ["k"], 3, fanout).first()["root"] == tree(digests, 3, fanout)
    swapped = df.withColumn("at", F.when(F.col("at") < 2, 1 - F.col("at")).otherwise(F.col("at")))
    assert (chains.roots(swapped, ["k"], 3, fanout).first()["root"] == tree(digests, 3, fanout)) == (n == 1)


def test_faults_are_found(spark):
    base = chains.sealed(spark.createDataFrame(records(spark, 6, list("abcdefghi")), RECORD)).cache()
    committed = chains.manifests(base).where("segment <> 'i'")
    rows = [tuple(r) for r in base.collect()]
    change = {
        "a": lambda r: [r], "b": lambda r: [] if r[1] == 2 else [r], "c": lambda r: [] if r[1] == 5 else [r], "d": lambda r: [(*r[:2], "changed", *r[3:])] if r[1] == 4 else [r],
        "e": lambda r: [r, r] if r[1] == 3 else [r], "f": lambda r: [(r[0], {1: 2, 2: 1}.get(r[1], r[1]), *r[2:])], "g": lambda r: [], "h": lambda r: [], "i": lambda r: [r],
    }
    # h is sealed anew without its first record: every link holds, only the manifest tells
    anew = [tuple(r) for r in chains.sealed(spark.createDataFrame([("h", i, f"h{i + 1}") for i in range(6)], RECORD)).collect()]
    left = spark.createDataFrame([x for r in rows for x in change[r[0]](r)] + anew, base.schema).repartition(4)
    got = {r["segment"]: (r["records"], r["first_fault"], r["verdict"]) for r in chains.verified(left, committed).collect()}
    assert got == {
        "a": (6, None, "ok"), "b": (5, 3, "predecessor_missing"), "c": (5, None, "count_differs"), "d": (6, 4, "content_changed"), "e": (7, 3, "ordinal_repeated"),
        "f": (6, 1, "content_changed"), "g": (0, None, "segment_missing"), "h": (6, None, "root_differs"), "i": (6, None, "segment_unknown"),
    }
    foreign = spark.createDataFrame([("a", 0, "x", "wrong", None)], base.schema).withColumn("digest", chains.record_digest(F.col("segment"), F.col("ordinal"), F.col("prev"), F.col("content")))
    assert [r["fault"] for r in chains.faults(foreign).collect()] == ["wrong_genesis"]
    relinked = base.where("segment = 'a'").withColumn("prev", F.when(F.col("ordinal") == 2, "z").otherwise(F.col("prev"))).withColumn("digest", chains.record_digest(F.col("segment"), F.col("ordinal"), F.col("prev"), F.col("content")))
    assert {r["ordinal"]: r["fault"] for r in chains.faults(relinked).collect()} == {0: None, 1: None, 2: "link_broken", 3: "link_broken", 4: None, 5: None}
    heads = chains.heads(committed.withColumn("archive", F.lit(1)).withColumn("place", F.ascii("segment") - 97), "archive", "place")
    moved = chains.heads(committed.withColumn("archive", F.lit(1)).withColumn("place", 200 - F.ascii("segment")), "archive", "place")
    assert heads.first()["segments"] == 8 and heads.first()["head"] != moved.first()["head"]


def cuts_by_hand(rows, most_records, most_bytes, most_age):
    out = []
    for k in {r[0] for r in rows}:
        no, n, total, opened = 0, 0, 0, None
        for key, i, t, size in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
            if n and (n >= most_records or total >= most_bytes or (opened is not None and t is not None and t - opened >= most_age)):
                no, n, total, opened = no + 1, 0, 0, None
            opened = t if opened is None else opened
            out.append((key, i, no, n))
            n, total = n + 1, total + (size or 0)
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [(5, 10**9, 10**9), (10**9, 30, 10**9), (10**9, 10**9, 40), (4, 25, 30), (1, 1, 1)])
def test_rotation(spark, limits):
    rng = random.Random(sum(limits))
    rows = [(k, i, rng.randrange(400), rng.choice([None, 0, 3, 9])) for k in (1, 2, None) for i in range(60)] + [(3, 1, None, 5), (3, 2, 7, 5), (3, 2, 7, 5), (3, 4, None, 5)]
    df = spark.createDataFrame(rows, "key long, id long, t long, size long").repartition(3)
    got = chains.rotated(df, "key", ["t", "id"], "t", F.col("size"), *limits).select("key", "id", "segment_no", "place").collect()
    assert sorted(map(tuple, got), key=str) == cuts_by_hand(rows, *limits)
    assert chains.rotated(df.limit(0), "key", ["t", "id"], "t", F.col("size"), *limits).count() == 0


def test_segments_on_files(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = spark.createDataFrame([(k, i, 10 * i, f"payload {i}") for k in ("x", "y") for i in range(25)], "key string, id long, t long, text string")
    made = segments.write_segments(rows, path, "key", ["t", "id"], "t", F.col("text"), 10, 10**6, 10**9)
    assert {r["segment"]: r["records"] for r in made.collect()} == {f"{k}-{n:08d}": 10 if n < 2 else 5 for k in "xy" for n in range(3)}
    assert {r["verdict"] for r in segments.verify(spark, path).collect()} == {"ok"}
    assert segments.read_segments(spark, path, "ordinal long, id long").where("corrupt IS NULL").count() == 50
    file = lambda s: next(Path(path, f"segment={s}").glob("*.json.gz"))

    def rewrite(segment, change):
        lines = gzip.open(file(segment), "rt").read().splitlines()
        Path(file(segment).parent, f".{file(segment).name}.crc").unlink(missing_ok=True)
        with gzip.open(file(segment), "wt") as out:
            out.write(change(lines))

    rewrite("x-00000000", lambda lines: "\n".join(lines)[:-20])  # a torn tail
    rewrite("x-00000001", lambda lines: "\n".join(reversed(lines)))  # lines in another order are still the same records
    rewrite("y-00000000", lambda lines: "\n".join([lines[0].replace("payload 0", "payload !"), *lines[1:]]))
    rewrite("y-00000001", lambda lines: "\n".join(lines[:4] + lines[5:]))
    file("y-00000002").unlink()
    got = {r["segment"]: (r["verdict"], r["torn"]) for r in segments.verify(spark, path).collect()}
    assert got == {"x-00000000": ("count_differs", 1), "x-00000001": ("ok", 0), "x-00000002": ("ok", 0), "y-00000000": ("content_changed", 0), "y-00000001": ("predecessor_missing", 0), "y-00000002": ("segment_missing", 0)}
    with pytest.raises(Exception, match="exist"):
        segments.commit(spark, path)


def test_torn_tail(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"k": 1, "id": 2}\n{"k": 1, "i')
    rows = segments.read_segments(spark, str(tmp_path), "k long, id long").collect()
    assert [(r["k"], r["id"]) for r in rows if r["corrupt"] is None] == [(1, 2)]
    assert [r["corrupt"] for r in rows if r["corrupt"] is not None] == ['{"k": 1, "i']
    assert json.loads('{"k": 1, "id": 2}')["k"] == rows[0]["k"]
