"""Exact and near dedup, sharding, against brute force."""

import hashlib
import math
import random
import re
import tempfile
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import common, components, exact_dedup, near_dedup, sharding


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("trie_bytes", [exact_dedup.TRIE_BYTES, 2000])
def test_exact_dedup(odd, odd_rows, empty, trie_bytes):
    groups = defaultdict(list)
    for d, t in odd_rows:
        groups[normalised(t)].append(d)
    want = []
    for d, t in odd_rows:
        ids = [x for x in groups[normalised(t)] if x is not None]
        keep = min(ids) if ids else None
        want.append((d, keep, len(groups[normalised(t)]), d == keep, hashlib.sha256(normalised(t).encode()).hexdigest()))
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(odd, trie_bytes).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_normalised_bytes():
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice(" \t\n\x0b\x0c\r\x1c\x85 ab") for _ in range(rng.randrange(9)))
        assert exact_dedup.normalised(t.encode()).decode() == normalised(t), repr(t)


@pytest.mark.parametrize("budget", [10**9, 5000, 400, 1])
def test_trie_spills_and_merges(budget, monkeypatch):
    rng, want, rows, spilled = random.Random(budget), {}, [], []
    make = tempfile.TemporaryFile
    monkeypatch.setattr(exact_dedup.tempfile, "TemporaryFile", lambda: spilled.append(1) or make())
    for _ in range(1500):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))) + (b"x" * 300 if rng.random() < 0.05 else b"")
        keep = rng.choice([None, rng.randrange(1000)])
        rows.append((text, keep, 2))
        had = want.get(text, (None, 0))
        want[text] = (exact_dedup.smaller(had[0], keep), had[1] + 2)
    got = list(exact_dedup.owners(iter(rows), budget))
    assert len(got) == len(want)
    assert {t: (k, n) for t, k, n in got} == want
    assert bool(spilled) == (budget < 10**9)


def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_components(rows, percent):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def near_rows():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for size in (30, 90, 200):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for k in range(40):  # a family around the threshold, most pairs of it not linked
            words = list(base)
            for _ in range(k % 9):
                words[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    return rows + [(len(rows) + i, t) for i, t in enumerate(["", None, " \n", "a b c", "A b\tc", "a b c d", *[" ".join(rng.choice(vocabulary) for _ in range(50)) for _ in range(30)]])]


@pytest.mark.parametrize(("percent", "block"), [(80, near_dedup.BLOCK), (85, 7)])
def test_near_dedup_finds_every_link(spark, percent, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_ITEMS", 250 * block)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_components(rows, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(df, percent).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 25


def test_near_dedup_odd_rows(odd, odd_rows, empty):
    rows = near_dedup.near_dedup(odd, 85).collect()
    assert len(rows) == len(odd_rows)
    known = {}
    for d, t in odd_rows:
        if d is not None:
            known[d] = t
    want = brute_components(list(known.items()), 85)
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert sorted(r["component_id"] is None for r in rows if r["doc_id"] is None) == [False, False, True]
    assert near_dedup.near_dedup(empty).count() == 0


def test_contracted_links_join_the_same_rows(spark):
    rng = random.Random(9)
    star = {(rng.randrange(50, 400), rng.randrange(60)) for _ in range(500)} | {(5, 7), (7, 5), (9, 5)}
    star = {(a, b) for a, b in star if a != b}
    df = spark.createDataFrame(sorted(star), "a long, b long")
    small = near_dedup._contracted(df)
    assert {tuple(r) for r in components.connected_components(small).collect()} == {tuple(r) for r in components.connected_components(df).collect()}


def test_sketch_estimates_high_similarities():
    rng = np.random.default_rng(1)
    errors, missed = [], 0
    limit = near_dedup.sketch_distance_limit(0.85)
    for j in (0.85, 0.9, 0.95):
        for _ in range(40):
            union, shared = rng.integers(0, 2**63, 1000, dtype=np.uint64), int(1000 * j)
            rest = (1000 - shared) // 2
            a, b = union[: shared + rest], np.concatenate([union[:shared], union[shared + rest :]])
            x = near_dedup.xor_count(near_dedup.odd_sketch(near_dedup.minhash(a)), near_dedup.odd_sketch(near_dedup.minhash(b)))
            errors.append(near_dedup.estimated_similarity(x) - j)
            missed += x > limit
    assert abs(np.mean(errors)) < 0.01
    assert np.std(errors) < 0.035
    assert missed == 0


def test_components(spark):
    rng, edges = random.Random(6), []
    for _ in range(120):
        edges.append((rng.randrange(200), rng.randrange(200)))
    edges += [(1000 + i, 1001 + i) for i in range(60)]  # a long path
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["component"] for r in components.connected_components(df).collect()} == {x: find(x) for x in list(parent)}
    assert components.connected_components(df.limit(0)).count() == 0


def test_sharding(odd, odd_rows, empty, spark):
    rows = sharding.assign_shards(odd, 5).collect()
    assert len(rows) == len(odd_rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r["doc_id"], r["shard"], r["grown_shard"]) for r in rows}) == len({d for d, _ in odd_rows})
    sizes = sorted((d is None, d or 0, len((t or "").encode()) + 1) for d, t in odd_rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in rows) == sizes
    assert sharding.assign_shards(empty).count() == 0
    many = spark.range(6000).selectExpr("id AS doc_id", "'' AS text")
    weighted = sharding.assign_shards(many, 3, weights=[1, 2, 3]).groupBy("shard").count().collect()
    assert all(abs(r["count"] - 1000 * (r["shard"] + 1)) < 150 for r in weighted)
    moved = sharding.assign_shards(many, 15).where("grown_shard <> shard").count()
    assert 250 < moved < 500  # a sixteenth
    with pytest.raises(ValueError):
        sharding.assign_shards(many, 3, weights=[1, 2])


def brute_shard(key, shards):
    def score(i):
        u = (int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:15], 16) + 0.5) / 16.0**15
        return 1.0 / -math.log(u)

    return max(range(shards), key=lambda i: (score(i), -i))


def test_sharding_against_brute_force(odd, odd_rows):
    got = sorted(((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in sharding.assign_shards(odd, 16).collect()), key=str)
    want = []
    for d, t in odd_rows:
        key, data = "null" if d is None else str(d), (t or "").encode()
        want.append((d, len(data) + 1, zlib.crc32(data), "key", brute_shard(key, 16), brute_shard(key, 17)))
    assert got == sorted(want, key=str)


def test_shared_dir_of_a_session_without_one(spark, monkeypatch):
    class Session:
        def __init__(self, **conf):
            self.conf = type("Conf", (), {"get": lambda _, name, default=None: conf.get(name, default)})()

    local = common.shared_dir(Session(**{"spark.master": "local[2]", "spark.app.id": "a"}), "x")
    assert local.startswith("file:///")
    assert local.rsplit("/", 1)[0] == common.shared_dir(Session(**{"spark.master": "local[2]", "spark.app.id": "a"}), "y").rsplit("/", 1)[0]
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session(**{"spark.master": "spark://host:7077"}), "x")
    assert common.shared_dir(Session(**{"spark.checkpoint.dir": "hdfs://n/shared/"}), "x").startswith("hdfs://n/shared/x-")
