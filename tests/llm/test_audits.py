"""Source divergence, benchmark decontamination and ranked search, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import bisection, decontamination, divergence, ranked_search
from tidemark.llm.fm_index import FMIndex, suffix_order
from tidemark.llm.words import LETTERS, LETTERS_AND_DIGITS, words


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def test_words():
    rng = random.Random(3)
    for _ in range(500):
        t = "".join(rng.choice("aZé9 _-\x7f\x80日\t@[`{Kı") for _ in range(rng.randrange(40)))
        for size in (1, 7, 10**6):
            assert [w.decode() for part in words(t.encode(), LETTERS_AND_DIGITS, size) for w in part] == word_list(t)
            assert [w.decode() for part in words(t.encode(), LETTERS, size) for w in part] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))


# divergence


def diverged(rows, least, top):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))) for lang, source, t in rows]
    groups, out = {(a, b) for a, b, _ in rows}, []
    for lang in {a for a, _ in groups}:
        docs, n, by = Counter(), Counter(), defaultdict(Counter)
        for a, b, w in rows:
            if a == lang:
                docs.update(set(w))
                n.update(w)
                by[b].update(w)
        kept = [t for t in docs if docs[t] >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        whole, sources = share(n), [b for a, b in groups if a == lang]
        p = {b: share(by[b]) for b in sources}
        for b in sources:
            pairs = [(sum(abs(p[b][t] - p[o][t]) for t in kept), o) for o in sources if o != b]
            terms = [(p[b][t] - whole[t], t) for t in kept if by[b][t] and p[b][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, b, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def source_rows():
    rng = random.Random(5)
    common, rare = [f"w{chr(97 + i)}" for i in range(20)], [f"r{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(8)]
    rows = [("en", f"s{rng.randrange(9)}", " ".join([rng.choice(common) for _ in range(30)] + [rng.choice(rare) for _ in range(6)])) for _ in range(260)]
    rows += [("de", "s1", "Wa wb é日 wa"), ("de", "s1", None), ("de", "s2", ""), ("fr", "s1", "Wa_wa 9wa")] + [("es", s, f"x{'y' * i}") for i, s in enumerate(("a", "b", "é", "Z"))]
    return rows + [(None, None, "wa wb"), (None, "s", "wa"), ("", None, "wb wb"), ("en", None, None), ("en", "s1", "wa wa"), ("en", "s1", "wa wa")]


@pytest.mark.parametrize(("least", "tile", "block", "share"), [(3, 4096, 512, 4), (3, 16, 3, 2), (1, 64, 2, 1000), (2, 8, 512, 1), (10**6, 16, 3, 4)])
def test_divergence(spark, monkeypatch, least, tile, block, share):
    rows = source_rows()
    for name, value in (("TILE", tile), ("BLOCK_SOURCES", block), ("HEAVY_SHARE", share), ("BROADCAST_GROUPS", 0 if block == 3 else 10**6)):
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame([(*r, 1, 2, 3, "x", 4) for r in rows], "lang string, source string, text string, n long, p long, tile int, term string, block int").repartition(3)
    got = sorted(tuple(r) for r in divergence.divergence(docs, least, 4).collect())
    assert got == diverged(rows, least, 4)


def test_divergence_of_no_rows(spark, empty):
    out = divergence.divergence(empty)
    assert out.count() == 0 and out.columns == ["lang", "source", "part", "item", "value", "rank"]


# decontamination


@pytest.mark.parametrize("seed", range(40))
def test_fm_index(seed):
    rng = np.random.default_rng(seed)
    text = np.append(np.where(rng.random(n := int(rng.integers(1, 150))) < 0.1, 0, rng.integers(1, int(rng.integers(1, 12)) + 1, n)), 0).astype(np.int32)
    text = np.concatenate([text] * 3) if seed % 3 == 0 else text  # copies
    ended = [[(1, int(x)) if x else (0, j) for j, x in enumerate(text[i:], i)] for i in range(len(text))]
    assert suffix_order(text).tolist() == sorted(range(len(text)), key=ended.__getitem__)
    index = FMIndex.from_bytes(FMIndex.of(text).to_bytes())
    for length in (1, 2, 3, 10):
        phrases = rng.integers(1, int(text.max(initial=1)) + 1, (15, length)) if text.max() else np.zeros((0, length), np.int64)
        for phrase, low, high in zip(phrases, *index.search(phrases), strict=True):
            want = [i for i in range(len(text) - length + 1) if (text[i : i + length] == phrase).all()]
            assert sorted(index.locate(np.arange(low, high)).tolist()) == want


def contaminated(docs, items, size):
    windows = defaultdict(set)
    for item, text in items:
        w = word_list(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = word_list(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])] - {None}
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def item_rows(odd_rows):
    texts = [t for _, t in odd_rows if t and len(t.split()) > 20]
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    return [(1, cut(texts[0], 5, 30)), (2, cut(texts[1], 0, 10).upper()), (10, cut(texts[2], 3, 6)), (10, cut(texts[3], 3, 14)), (3, None), (4, " \n"), (5, "absent words only"), (None, cut(texts[4], 2, 13)), (21, cut(texts[0], 5, 30)), (6, "w7"), (6, "w7"), (7, "日本語"), (8, "it's, don't")]


@pytest.mark.parametrize(("size", "shard", "at_once"), [(10, 1 << 20, 10**6), (10, 300, 10**6), (4, 25, 7), (3, 1 << 20, 10), (1, 40, 10**6)])
def test_contamination(spark, odd, odd_rows, size, shard, at_once):
    items = item_rows(odd_rows)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, row long, words string")
    found = decontamination.contamination(odd, df, size, shard, at_once)
    got = sorted(map(tuple, decontamination.contamination_report(found).collect()), key=str)
    assert got == contaminated(odd_rows, items, size)
    for r in found.collect():
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False)) and r["items"] == sorted(set(r["items"]))


def test_contamination_of_no_rows(spark, odd, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(empty, items).count() == 0
    assert decontamination.contamination(odd, items).where("size(spans) > 0 or size(items) > 0").count() == 0


def test_without_spans(spark, odd, odd_rows):
    items = item_rows(odd_rows)
    df = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.without_spans(odd, df)
    assert out.columns == odd.columns and out.count() == odd.count()
    was = {r["doc_id"]: r for r in odd.where("doc_id > 4").collect()}
    hit = {d for d, *_, c in contaminated(odd_rows, items, 10) if c}
    changed = {r["doc_id"] for r in out.where("doc_id > 4").collect() if r["text"] != was[r["doc_id"]]["text"]}
    assert changed == {d for d in hit if d is not None and d > 4} and changed
    assert {r["row"] for r in out.collect()} == {1}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())


# ranked search


def ranked(docs, items, top):
    docs = [(d, Counter(w := word_list(t)), len(w)) for d, t in docs]
    n_docs, total = sum(n > 0 for *_, n in docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = defaultdict(Counter)
    for item, text in items:
        asked[item].update(word_list(text))
    out = []
    for item, terms in asked.items():
        found = []
        for d, c, n in docs:
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // total))) for t, k in terms.items() if c[t])
            found += [(-score, d is None, d)] if score > 0 else []
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("top", "shard", "cluster", "at_once"), [(20, 4096, 64, 10**6), (3, 16, 2, 10**6), (1, 7, 3, 5), (200, 4096, 1, 10**6)])
def test_search(spark, odd, odd_rows, monkeypatch, top, shard, cluster, at_once):
    items = [*item_rows(odd_rows), (30, "zzz"), (31, "w1 w1 w1 w2"), (32, "one two three four")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank long, doc_id long")
    index = ranked_search.written(ranked_search.build_index(odd, shard, cluster), "index")
    assert sorted(d for r in index.collect() for d in r["doc_ids"] if d is not None) == sorted(d for d, _ in odd_rows if d is not None)
    got = sorted(map(tuple, ranked_search.search_index(index, df, top, at_once).collect()), key=str)
    assert got == ranked(odd_rows, items, top)


def test_search_of_no_rows(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one")], "item_id long, text string")
    for docs, items in ((odd, none), (empty, some), (empty, none), (odd.where("text is null"), some)):
        assert ranked_search.search(docs, items).count() == 0


def test_bisection_brings_topics_together():
    rng = np.random.default_rng(2)
    topic = rng.permutation(np.repeat(np.arange(8), 32))
    postings = {(d, int(t)) for d in range(256) for t in np.concatenate([100 * topic[d] + rng.integers(0, 60, 25), 5000 + rng.integers(0, 100, 5)])}
    doc, term = np.array(sorted(postings)).T
    order = bisection.bisected(doc, term, 256, 32)
    assert sorted(order.tolist()) == list(range(256))
    purity = np.mean([np.bincount(topic[order[i : i + 32]]).max() / 32 for i in range(0, 256, 32)])
    assert purity > 0.8
    assert bisection.bisected(doc[:0], term[:0], 5, 2).tolist() == list(range(5)) and bisection.bisected(doc[:0], term[:0], 0, 2).tolist() == []


def test_few_clusters_are_visited(spark, data, monkeypatch):
    """Only clusters whose bound reaches the floor are opened; here a smaller part of all (query, cluster) pairs."""
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = ranked_search.build_index(docs, 4096, 8).collect()
    asked = ranked_search.query_terms(items).collect()
    n, total = sum(x > 0 for r in rows for x in r["lengths"]), sum(x for r in rows for x in r["lengths"])
    df = Counter()
    for r in rows:
        df.update(dict(zip(bytes(r["terms"]).split(b" "), np.diff(np.frombuffer(r["ends"], np.int32), prepend=0).tolist(), strict=True)))
    queries = ranked_search.Queries.of(asked, df, n, total)
    clusters = [ranked_search._Cluster({k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.asDict().items()}, queries) for r in rows]
    bounds = np.stack([c.bounds(queries.flat()) for c in clusters])
    for q in range(len(queries.items)):
        scores = [c.scores(q) for c in clusters]
        assert all(s.max() <= b for s, b in zip(scores, bounds[:, q], strict=True))
    floors = [sorted(np.concatenate([c.scores(q) for c in clusters]))[-20] for q in range(len(queries.items))]
    assert (bounds >= floors).mean() < 0.8
