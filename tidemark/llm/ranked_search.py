"""Ranked lexical search over a clustered index.

A task cuts its documents into shards, orders each shard by recursive graph bisection and writes runs of
neighbours in that order as clusters: a row with the cluster's posting lists and, for each term, the largest
count and the smallest length of a document that has it. These bound the score that any document of
the cluster can reach. For each query, the clusters with the largest bounds of all are scored first;
their 20th score is a floor. Then every shard visits its clusters by falling bounds and stops
where a bound is below the floor or the scores it has found itself. So results are exact.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bisection import bisected
from .common import put_on_path, written
from .words import LETTERS_AND_DIGITS, byte_blocks, words

TOP = 20
#: Documents and postings of a shard, at most but for its last document; documents of a cluster.
SHARD_DOCUMENTS, SHARD_POSTINGS, CLUSTER_DOCUMENTS = 2048, 1 << 20, 64
#: Distinct terms of queries, each with a query, that are searched at once (some 100 bytes each, broadcast).
TERMS_AT_ONCE = 200_000
#: Clusters per query that give the floor.
FIRST_CLUSTERS = 2

_INDEX = "cluster long, doc_ids array<long>, lengths array<long>, terms binary, most binary, least binary, ends binary, places binary, counts binary"
_NAMES = [x.split()[0] for x in _INDEX.split(", ")]


def _cluster(doc_ids: list[int | None], lengths: np.ndarray, names: list[bytes], doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> tuple:
    """A row of the index, without its number, of postings (doc, term, count) sorted by term; doc from 0 on."""
    heads = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    ends = np.concatenate([heads[1:], [len(term)]]) if len(term) else heads
    most = np.maximum.reduceat(count, heads) if len(term) else heads
    least = np.minimum.reduceat(lengths[doc], heads) if len(term) else heads
    terms = b" ".join(names[t] for t in term[heads].tolist())
    return (doc_ids, lengths.tolist(), terms, most.astype(np.int32).tobytes(), least.astype(np.int32).tobytes(), ends.astype(np.int32).tobytes(), doc.astype(np.uint16).tobytes(), count.astype(np.int32).tobytes())


class _Shard:
    """Documents of a shard as they come."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        counts: Counter = Counter()
        for part in words(text, LETTERS_AND_DIGITS):
            counts.update(part)
        numbers = self.numbers
        self.ids.append(doc_id)
        self.terms.append(np.fromiter((numbers.setdefault(t, len(numbers)) for t in counts), np.int64, len(counts)))
        self.counts.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.postings += len(counts)

    def clusters(self, size: int) -> Iterator[tuple]:
        n = len(self.ids)
        sizes = np.array([len(t) for t in self.terms])
        doc, term, count = np.repeat(np.arange(n), sizes), np.concatenate(self.terms), np.concatenate(self.counts)
        lengths = np.array([int(c.sum()) for c in self.counts], np.int64)
        order = bisected(doc, term, n, size)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        at = np.lexsort((place[doc], term, place[doc] // size))
        doc, term, count = place[doc][at], term[at], count[at]
        names = list(self.numbers)
        for start in range(0, n, size):
            s, e = np.searchsorted(doc // size, [start // size, start // size + 1])
            own = order[start : start + size]
            yield _cluster([self.ids[i] for i in own.tolist()], lengths[own], names, doc[s:e] - start, term[s:e], count[s:e])


def build_index(docs: DataFrame, shard_documents: int = SHARD_DOCUMENTS, cluster_documents: int = CLUSTER_DOCUMENTS) -> DataFrame:
    """The clustered index of ``docs`` (doc_id, text): a row per cluster, the clusters of a shard one after another.

    Every row and all terms are in it; null and empty texts have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        shard = _Shard()

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for row in shard.clusters(cluster_documents):
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((number, *row), kinds, strict=True)], _NAMES)
                number += 1

        for block, texts in byte_blocks(batches, 1):
            for doc_id, text in zip(block.column(0).to_pylist(), texts, strict=True):
                shard.add(doc_id, text)
                if len(shard.ids) >= shard_documents or shard.postings >= SHARD_POSTINGS:
                    yield from rows()
                    shard = _Shard()
        if shard.ids:
            yield from rows()

    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())] + [pa.binary()] * 6
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _INDEX)


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of ``items`` (item_id, text)."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(found).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(count: np.ndarray, length: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What a term's weight is multiplied by: it rises with the count and falls with the document's length."""
    return 1_000_000_000 * count // (1000 * count + 12 * (75 + 25 * length * n_docs // total))


@dataclass
class Queries:
    """A block of queries: each one's terms (numbers) and weights times repeats, and what impacts need."""

    items: list[int | None]
    numbers: dict[bytes, int]
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    n_docs: int
    total: int

    @classmethod
    def of(cls, rows: list, df: dict[bytes, int], n_docs: int, total: int) -> Queries:
        numbers: dict[bytes, int] = {}
        by: dict[int | None, list[tuple[int, int]]] = {}
        for item, term, times in rows:
            t = term.encode()
            if df.get(t, 0):
                by.setdefault(item, []).append((numbers.setdefault(t, len(numbers)), times * weight(n_docs, df[t])))
        split = [np.array(x, np.int64).reshape(-1, 2) for x in by.values()]
        return cls(list(by), numbers, [x[:, 0] for x in split], [x[:, 1] for x in split], n_docs, total)

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.cumsum([0, *map(len, self.terms)])[:-1]
        return np.concatenate(self.terms), np.concatenate(self.weights), starts


class _Cluster:
    """A row of the index, seen by a block of queries; its posting lists are opened when a query visits it."""

    def __init__(self, row: dict, queries: Queries):
        self.row, self.queries, self.values = row, queries, None
        names = row["terms"].split(b" ") if row["terms"] else []
        numbers = queries.numbers
        found = [(i, numbers[t]) for i, t in enumerate(names) if t in numbers]
        self.at = np.array([i for i, _ in found], np.int64)
        self.place = np.full(len(numbers) + 1, len(found), np.int64)  # of a term in the lists below; the last stands for none
        self.place[[n for _, n in found]] = np.arange(len(found))

    def bounds(self, flat: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """No document's score for a query is above its bound."""
        most, least = (np.frombuffer(self.row[c], np.int32)[self.at].astype(np.int64) for c in ("most", "least"))
        top = np.append(impact(most, least, self.queries.n_docs, self.queries.total), 0)
        terms, weights, starts = flat
        return np.add.reduceat(weights * top[self.place[terms]], starts)

    def scores(self, query: int) -> np.ndarray:
        if self.values is None:
            lengths = np.array(self.row["lengths"], np.int64)
            ends = np.frombuffer(self.row["ends"], np.int32).astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]])[self.at]
            sizes = ends[self.at] - starts
            take = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            doc = np.frombuffer(self.row["places"], np.uint16)[take].astype(np.int64)
            count = np.frombuffer(self.row["counts"], np.int32)[take].astype(np.int64)
            self.values = np.zeros((len(self.at) + 1, len(lengths)), np.int64)
            self.values[np.repeat(np.arange(len(self.at)), sizes), doc] = impact(count, lengths[doc], self.queries.n_docs, self.queries.total)
        own = self.queries.terms[query]
        return (self.queries.weights[query][:, None] * self.values[self.place[own]]).sum(axis=0)


class _Best:
    """A query's best documents so far: larger scores first, then smaller ids, rows without one last."""

    def __init__(self, top: int, floor: int):
        self.top, self.floor, self.held = top, max(1, floor), []

    def least(self) -> int:
        """A document below this score is not among the best."""
        return max(self.floor, self.held[0][0]) if len(self.held) == self.top else self.floor

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        for i in np.flatnonzero(scores >= self.least()).tolist():
            entry = (int(scores[i]), ids[i] is not None, -(ids[i] or 0))
            if len(self.held) < self.top:
                heapq.heappush(self.held, entry)
            elif entry > self.held[0]:
                heapq.heapreplace(self.held, entry)

    def rows(self) -> Iterator[tuple[int | None, int]]:
        for score, named, doc_id in self.held:
            if score >= self.floor:
                yield -doc_id if named else None, score


def _rows(batches: Iterator[pa.RecordBatch], queries: Queries, at_once: int) -> Iterator[list[_Cluster]]:
    for batch in batches:
        for s in range(0, batch.num_rows, at_once):
            yield [_Cluster(row, queries) for row in batch.slice(s, at_once).to_pylist()]


def _first_clusters(index: DataFrame, queries: Queries, n: int) -> DataFrame:
    """(query, cluster): the ``n`` clusters with the largest bounds of each query."""
    held = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = held.value.flat()
        best: list[list[tuple[int, int]]] = [[] for _ in held.value.items]
        for clusters in _rows(batches, held.value, 1):
            bounds, number = clusters[0].bounds(flat), clusters[0].row["cluster"]
            for q in np.flatnonzero(bounds).tolist():
                best[q] = heapq.nlargest(n, [*best[q], (int(bounds[q]), number)])
        rows = [(q, number, bound) for q, found in enumerate(best) for bound, number in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((), (), ()))], ["query", "cluster", "bound"])

    found = index.select("cluster", "terms", "most", "least").mapInArrow(run, "query long, cluster long, bound long")
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "cluster")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query", "cluster")


def _visited(index: DataFrame, queries: Queries, floors: list[int], top: int) -> DataFrame:
    """(query, doc_id, score): of each shard, the documents that may be among a query's best."""
    held = index.sparkSession.sparkContext.broadcast((queries, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, floors = held.value
        flat, best = queries.flat(), [_Best(top, f) for f in floors]
        for clusters in _rows(batches, queries, SHARD_DOCUMENTS // CLUSTER_DOCUMENTS):
            bounds = np.stack([c.bounds(flat) for c in clusters])
            for q in np.flatnonzero((bounds >= [b.least() for b in best]).any(axis=0)).tolist():
                for c in np.argsort(-bounds[:, q], kind="stable").tolist():
                    if bounds[c, q] < best[q].least():
                        break
                    best[q].add(clusters[c].scores(q), clusters[c].row["doc_ids"])
        rows = [(q, *x) for q, b in enumerate(best) for x in b.rows()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((), (), ()))], ["query", "doc_id", "score"])

    return index.drop("cluster").mapInArrow(run, "query long, doc_id long, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _document_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df) of the queries' terms."""
    held = index.sparkSession.sparkContext.broadcast({r["term"].encode() for r in terms.select("term").distinct().collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, df = held.value, Counter()
        for batch in batches:
            for names, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sizes = np.diff(np.frombuffer(ends, np.int32), prepend=0).tolist()
                for t, n in zip(names.split(b" ") if names else (), sizes, strict=True):
                    if t in wanted:
                        df[t] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), pa.array(df.values(), pa.int64())], ["term", "df"])

    return index.select("terms", "ends").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, terms_at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """The ``top`` documents of ``docs`` (doc_id, text) with the highest scores above 0 for each of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Terms are maximal runs of ASCII letters, lower-cased, digits and code points from 0x80 on; the score is
    a sum over the item's terms, repeats included, of whole numbers (``weight``, ``impact``). Equal scores rank by doc_id,
    rows without one last. Null and empty texts have no terms, and are not counted as documents; a
    repeated row is a document each time; items without terms, or with none that occurs, give no rows; rows that repeat
    an item_id are one item (null too). Empty tables give no rows; further columns are ignored.

    Queries go in blocks of ``terms_at_once`` (query, term) pairs at most, but for a longer one; each block's are broadcast.
    """
    put_on_path(docs.sparkSession)
    index = written(build_index(docs), "index")
    return search_index(index, items, top, terms_at_once)


def search_index(index: DataFrame, items: DataFrame, top: int = TOP, terms_at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """``search`` over a written index."""
    spark = index.sparkSession
    with_terms = F.filter("lengths", lambda n: n > 0)
    totals = index.select(F.size(with_terms).cast("long").alias("n"), F.aggregate(with_terms, F.lit(0).cast("long"), lambda a, n: a + n).alias("total")).agg(F.sum("n"), F.sum("total")).first()
    n_docs, total = totals[0] or 0, totals[1] or 0
    asked = written(query_terms(items), "queries")
    pairs = asked.count()
    blocks = max(1, -(-pairs // terms_at_once))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks if pairs and total else 0):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        df = {bytes(r["term"]): r["df"] for r in _document_counts(index, own).collect()}
        queries = Queries.of(own.collect(), df, n_docs, total)
        if not queries.items:
            continue
        first = written(_first_clusters(index, queries, FIRST_CLUSTERS), "first")
        seeds = index.join(F.broadcast(first.select("cluster").distinct()), "cluster", "left_semi")  # some clusters per query of the block
        floors = [0] * len(queries.items)
        for r in _ranked(_visited(seeds, queries, floors, top), top).where(F.col("rank") == top).collect():
            floors[r["query"]] = r["score"]
        names = spark.createDataFrame(list(enumerate(queries.items)), "query long, item_id long")
        best = _ranked(_visited(index, queries, floors, top), top).join(F.broadcast(names), "query")  # as many as the block has queries
        out = out.union(best.select("item_id", "rank", "doc_id", "score"))
    return out
