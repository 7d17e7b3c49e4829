"""Toxicity and nearest neighbours: held-out accuracy, recall, and odd rows."""

import math
import random

import numpy as np
import pytest

from tidemark.llm import ann, toxicity


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    bad = ["vile", "awful", "rotten", "nastyish", "nastyous", "nastyer"]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 80))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randrange(1, 9) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def features(text):
    return np.array(sorted(f for w in toxicity.words(text) for f in toxicity.features(w)), np.int64)


def test_held_out_accuracy(spark):
    rows = toxic_corpus(3000, 1)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows if d < 2000], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, fit_rows=1500)
    assert np.all(np.diff(model.cuts) > 0)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(y, got[d]) for d, _, y in rows if d >= 2000]
    assert sum(r["toxic"] == bool(y) for y, r in held) / len(held) > 0.98
    assert all(0 <= r["severity"] <= 3 and 0 <= r["grade"] <= 3 for r in got.values())
    kept = {r["doc_id"] for r in toxicity.without_toxic(docs, model).collect()}
    assert kept == {d for d, r in got.items() if not r["toxic"]}
    # severity follows the number of toxic words
    count = {d: sum(w in toxicity.words(t) for w in (b"vile", b"awful", b"rotten", b"nastyish", b"nastyous", b"nastyer")) for d, t, _ in rows}
    by = [np.mean([got[d]["severity"] for d in count if count[d] == k]) for k in range(5)]
    assert by == sorted(by)


def test_ordered_grades_share_weights():
    rng = np.random.default_rng(2)
    rows, grades = [], []
    for _ in range(1500):
        k = int(rng.integers(0, 7))
        rows.append(np.sort(np.concatenate([np.full(k, 77), rng.integers(1000, 2000, 10)])))
        grades.append(min(3, k // 2))
    grades = np.array(grades)
    model = toxicity.fit_ordinal(rows, grades, 4)
    assert model.weights.keys() >= {77}
    above = model.above(np.array([sum(model.weights.get(int(f), 0) for f in r) for r in rows]))
    assert np.mean(np.round(above.sum(axis=1)) == grades) > 0.9
    assert np.all(np.diff(above, axis=1) <= 1e-12)


def test_degenerate_fits():
    assert toxicity.fit_ordinal([], np.array([], np.int64), 4).weights == {}
    model = toxicity.fit_ordinal([np.array([1, 2])] * 20, np.zeros(20, np.int64), 4)
    assert model.weights == {}
    assert np.all(model.above(np.zeros(1)) < 0.5)


def test_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(4, 0), (4, 1), (None, 1), (60, None), (61, 0), (999, 1)], "doc_id long, toxic int")
    assert {tuple(r) for r in toxicity.toxic_labels(labels).collect()} == {(4, 1), (61, 0), (999, 1)}
    model = toxicity.fit_toxicity(odd, labels)
    assert toxicity.score_toxicity(odd, model).count() == len(odd_rows)
    assert toxicity.without_toxic(odd, model).columns == odd.columns
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, labels)).count() == 0


def test_scores_against_brute_force(spark, odd, odd_rows):
    rows = toxic_corpus(800, 3)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int"))
    assert model.weights

    def plain(text):
        score = sum(model.weights.get(int(f), 0.0) for w in toxicity.words(text or "") for f in toxicity.features(w))
        above = [1 / (1 + math.exp(-(score - c))) for c in model.cuts]
        each = [1 - above[0], *(a - b for a, b in zip(above, above[1:], strict=False)), above[-1]]
        return sum(above), each.index(max(each)), above[0], above[0] > toxicity.REJECT

    for df, texts in ((docs, [(d, t) for d, t, _ in rows]), (odd, odd_rows)):
        got = sorted(((r["doc_id"], round(r["severity"], 9), r["grade"], round(r["p_toxic"], 9), r["toxic"]) for r in toxicity.score_toxicity(df, model).collect()), key=str)
        assert got == sorted(((d, round(s, 9), g, round(p, 9), x) for d, t in texts for s, g, p, x in [plain(t)]), key=str)


def vectors(n, dim, seed, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    v = centres[rng.integers(0, clusters, n)] + 0.4 * rng.normal(size=(n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], float)
    out = {}
    for q, v in queries:
        s = m @ np.array(v, float)
        out[q] = sorted((-s[i], int(ids[i])) for i in range(len(ids)) if ids[i] != q)[:k]
    return out


@pytest.mark.parametrize("shard", [400, 10_000])
def test_recall(spark, monkeypatch, shard):
    v = vectors(1500, 24, 3)
    rows = [(i, v[i].tolist()) for i in range(1500)]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], "vec_id long, embedding array<float>, label int")
    queries = [r for r in rows if r[0] % 20 == 0]
    found = ann.search_index(ann.build_index(df, 10, shard_vectors=shard), df.where("vec_id % 20 = 0"), 10).collect()
    want, got = brute(rows, queries, 10), {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert got.keys() == want.keys()
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) / (10 * len(want)) >= 0.9
    for q, x in got.items():
        assert x == sorted(x)
        assert all(abs(-s - float(np.dot(v[i].astype(float), v[q].astype(float)))) < 1e-12 for s, i in x)


def test_recall_on_the_embeddings_in_several_shards(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    queries = [r for r in rows if r[0] % 20 == 0]
    index = ann.build_index(df, 20, shard_vectors=len(rows) // 4)
    assert index.count() > 2
    want, got = brute(rows, queries, 20), {}
    for r in ann.search_index(index, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(got[q] & {i for _, i in want[q]}) for q in want) / (20 * len(want)) >= 0.9


def test_recall_on_a_full_shard():
    """8,192 vectors of 64 dimensions in clusters, a third of them one tight family."""
    rng, n, k = np.random.default_rng(7), ann.SHARD_VECTORS, 20
    centres = rng.normal(size=(60, 64))
    v = centres[rng.integers(0, 60, n)] + 0.5 * rng.normal(size=(n, 64))
    v[: n // 3] = centres[0] + 0.02 * rng.normal(size=(n // 3, 64))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    graph, seen, hits = ann.Hnsw.build(v), np.full(n, -1, np.int64), 0
    queries = rng.permutation(n)[:150].tolist()
    for mark, q in enumerate(queries, 1):
        near = set(graph.search(v[q], k + 1, ann.SEARCH_BREADTH, seen, mark)) - {q}
        hits += len(near & (set(np.argsort(-(v @ v[q]), kind="stable")[: k + 1].tolist()) - {q}))
    assert hits / (k * len(queries)) >= 0.95


def test_ids_with_several_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_SLICE", 2)
    rng = np.random.default_rng(4)
    rows = [(1, (1.0, 0.01 * i)) for i in range(40)] + [(2, (0.5, 0.0)), (3, (0.4, 0.0)), (4, (-1.0, 0.0)), (5, (0.9, 0.1)), (5, (0.1, 0.9))]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    df = spark.createDataFrame([(i, list(v)) for i, v in rows], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest_neighbours(df, df, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in (1, 2, 3, 4, 5):
        v = min(x for i, x in rows if i == q)
        best = {}
        for i, x in rows:
            if i != q:
                best[i] = max(best.get(i, -9.0), float(np.dot(x, v)))
        assert got[q] == sorted(best.items(), key=lambda b: (-b[1], b[0]))[:3]


def test_copies_ties_and_bad_vectors(spark):
    same = [1.0, 0.0, 0.0]
    rows = [(i, same) for i in range(60)] + [(100, [0.0, 1.0, 0.0]), (101, None), (102, [0.0, 0.0, 0.0]), (103, [math.nan, 1.0, 0.0]), (104, [math.inf, 0.0, 0.0]), (105, [None, 1.0, 0.0]), (None, same), (100, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, ids int")
    found = ann.nearest_neighbours(df, df.where("vec_id in (0, 40, 100, 101, 102, 103, 104, 105)"), 5).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [1, 2, 3, 4, 5], 40: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4]}
    few = spark.createDataFrame([(1, [1.0, 2.0], 0), (20, [2.0, 1.0], 0)], "vec_id long, embedding array<float>, label int")
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in ann.nearest_neighbours(few, few.where("vec_id = 20"), 5).collect()] == [(20, 1, 4.0)]
    assert ann.nearest_neighbours(few.limit(0), few, 5).count() == 0


def test_shards_grow_when_they_are_many():
    assert [ann.shard_count(n) for n in (0, 1, 8192, 8193, 2_097_152, 100_000_000, 10**9)] == [1, 1, 1, 2, 256, 763, 7630]
