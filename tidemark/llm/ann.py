"""Approximate nearest neighbours: an HNSW graph per shard as flat neighbour arrays, shard results merged."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import put_on_path, written

#: Links of a node on the upper layers; twice as many on the lowest.
LINKS = 16
BUILD_BREADTH, SEARCH_BREADTH = 64, 96
#: Distinct vectors of a shard and queries of a slice, on average.
SHARD_VECTORS, QUERY_SLICE = 8_192, 16_384
#: Shards, as each query goes to each of them: beyond so many they grow instead, up to this many vectors (some ten minutes to build).
MOST_SHARDS, LARGEST_SHARD = 256, 1 << 17


class Hnsw:
    """A graph over the rows of ``vectors`` by inner product; ``layers[k]`` is an int32 array (n, links), -1 where free."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], entry: int):
        self.vectors, self.layers, self.entry = vectors, layers, entry

    def search_layer(self, q: np.ndarray, starts: list[int], breadth: int, layer: np.ndarray, seen: np.ndarray, mark: int) -> list[tuple[float, int]]:
        """The ``breadth`` nearest nodes found from ``starts``, best first."""
        vectors = self.vectors
        seen[starts] = mark
        found = [(float(s), i) for s, i in zip(vectors[starts] @ q, starts, strict=True)]
        heapq.heapify(found)
        todo = [(-s, i) for s, i in found]
        heapq.heapify(todo)
        while todo:
            score, node = heapq.heappop(todo)
            if len(found) >= breadth and -score < found[0][0]:
                break
            near = layer[node]
            near = near[near >= 0]
            near = near[seen[near] != mark]
            if not len(near):
                continue
            seen[near] = mark
            scores = vectors[near] @ q
            if len(found) >= breadth:
                good = scores > found[0][0]
                near, scores = near[good], scores[good]
            for s, i in zip(scores.tolist(), near.tolist(), strict=True):
                if len(found) < breadth:
                    heapq.heappush(found, (s, i))
                elif s > found[0][0]:
                    heapq.heapreplace(found, (s, i))
                else:
                    continue
                heapq.heappush(todo, (-s, i))
        return sorted(found, reverse=True)

    def diverse(self, node: int, candidates: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
        """Neighbours that are nearer to the node than to one another; places left go to the nearest others."""
        order = np.argsort(-scores, kind="stable")
        candidates, scores = candidates[order], scores[order]
        among = self.vectors[candidates] @ self.vectors[candidates].T
        open_, kept = np.ones(len(candidates), bool), []
        for k in range(len(candidates)):
            if open_[k]:
                kept.append(k)
                if len(kept) == most:
                    break
                open_ &= among[k] <= scores
        if len(kept) < most:
            taken = set(kept)
            kept += [k for k in range(len(candidates)) if k not in taken][: most - len(kept)]
        return candidates[kept]

    @classmethod
    def build(cls, vectors: np.ndarray, links: int = LINKS, breadth: int = BUILD_BREADTH, seed: int = 7) -> Hnsw:
        n = len(vectors)
        heights = np.minimum((-np.log(1 - np.random.Generator(np.random.PCG64(seed)).random(n)) / np.log(links)).astype(int), 8)
        layers = [np.full((n, 2 * links if k == 0 else links), -1, np.int32) for k in range(int(heights.max(initial=0)) + 1)]
        graph, seen = cls(vectors, layers, 0), np.full(n, -1, np.int64)
        top, mark = int(heights[0]) if n else 0, 0
        for i in range(1, n):
            q, height, starts = vectors[i], int(heights[i]), [graph.entry]
            for k in range(top, -1, -1):
                mark += 1
                if k > height:
                    starts = [graph.search_layer(q, starts, 1, layers[k], seen, mark)[0][1]]
                    continue
                found = graph.search_layer(q, starts, breadth, layers[k], seen, mark)
                ids = np.array([x for _, x in found], np.int32)
                chosen = graph.diverse(i, ids, np.array([s for s, _ in found], vectors.dtype), links)
                layers[k][i, : len(chosen)] = chosen
                for j in chosen.tolist():
                    row = layers[k][j]
                    free = np.flatnonzero(row < 0)
                    if len(free):
                        row[free[0]] = i
                    else:
                        all_ = np.append(row, np.int32(i))
                        best = graph.diverse(j, all_, vectors[all_] @ vectors[j], len(row))
                        row[:] = -1
                        row[: len(best)] = best
                starts = ids.tolist()
            if height > top:
                top, graph.entry = height, i
        return graph

    def search(self, q: np.ndarray, k: int, breadth: int, seen: np.ndarray, mark: int) -> list[int]:
        """The k nearest rows found; ``seen`` is scratch of one number per row, ``mark`` new for each call by len(layers)."""
        starts = [self.entry]
        for layer in reversed(self.layers[1:]):
            starts = [self.search_layer(q, starts, 1, layer, seen, mark)[0][1]]
            mark += 1
        return [i for _, i in self.search_layer(q, starts, max(k, breadth), self.layers[0], seen, mark)][:k]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is not null, not zero and holds only finite numbers; the vector as array<double>."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where("vec_id is not null and embedding is not null").where(finite & F.exists("embedding", lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def shard_count(vectors: int, shard_vectors: int = SHARD_VECTORS) -> int:
    """Shards of ``shard_vectors`` each, as long as these are few; then larger ones, as a query's cost is its shards and each only grows with a logarithm."""
    size = min(max(shard_vectors, -(-vectors // MOST_SHARDS)), max(shard_vectors, LARGEST_SHARD))
    return max(1, -(-vectors // size))


def build_index(vectors: DataFrame, k: int, shard_vectors: int = SHARD_VECTORS, links: int = LINKS, breadth: int = BUILD_BREADTH) -> DataFrame:
    """A written index, one row per shard: shard, n, dim, ids (per vector up to k + 1 smallest vec_ids), vectors, layers, entry.

    Equal vectors are one node, or a graph of copies would lose its way: of each distinct vector
    the k + 1 smallest ids are kept, which is all that a query for k neighbours by ties can
    return, itself left out. Each vector's hash deals it to a shard; every row is indexed. Rows whose
    vector or vec_id ``usable`` leaves out take no part; an empty table gives an empty index; further
    columns are ignored.
    """
    put_on_path(vectors.sparkSession)
    smallest = Window.partitionBy("embedding").orderBy("vec_id")
    rows = usable(vectors).dropDuplicates(["vec_id", "embedding"]).withColumn("rank", F.row_number().over(smallest)).where(F.col("rank") <= k + 1)
    nodes = written(rows.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "nodes")
    shards = shard_count(nodes.count(), shard_vectors)
    nodes = nodes.withColumn("dim", F.size("embedding")).withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ids", key=lambda s: s.map(lambda x: x[0]), kind="stable")
        exact = np.stack(group["embedding"].to_list()).astype(np.float64)
        graph = Hnsw.build(exact.astype(np.float32), links, breadth)
        ids = [np.asarray(x, np.int64) for x in group["ids"]]
        return pd.DataFrame({
            "shard": [int(group["shard"].iloc[0])], "dim": [exact.shape[1]], "ids": [np.concatenate(ids).tobytes()], "counts": [np.array([len(x) for x in ids], np.int32).tobytes()],
            "vectors": [exact.tobytes()], "layers": [[x.tobytes() for x in graph.layers]], "widths": [[x.shape[1] for x in graph.layers]], "entry": [graph.entry],
        })

    schema = "shard long, dim int, ids binary, counts binary, vectors binary, layers array<binary>, widths array<int>, entry int"
    return written(nodes.repartition(4 * shards, "shard").groupBy("shard", "dim").applyInPandas(build, schema), "hnsw")


def search_index(index: DataFrame, queries: DataFrame, k: int = 20, breadth: int = SEARCH_BREADTH) -> DataFrame:
    """Each query's k nearest indexed vectors but itself: query_id, rank (from 1), vec_id, score (inner product in double).

    Queries are laid out once per shard, in slices of about QUERY_SLICE, and a shard once per slice: a task
    gets the shard first and streams the queries of the slice through it. What it finds is rescored on the
    original vectors, and of each query at most k rows leave it. Shards' results are merged by
    score, ties to the smaller vec_id. Rows that repeat a vec_id are one query, by its smallest
    vector; of an id with several vectors the best counts. Queries of another dimension than a
    shard's find nothing there; an empty index or no queries give no rows; further columns are ignored.
    """
    put_on_path(index.sparkSession)
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    slices = max(1, -(-asked.count() // QUERY_SLICE))
    last = index.agg(F.max("shard")).first()[0]
    shards = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last if last is not None else 0).cast("long")))
    asked = asked.withColumn("shard", shards).withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int"))
    laid = index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    both = laid.unionByName(asked, allowMissingColumns=True).repartition("shard", "dim", "slice").sortWithinPartitions("shard", "dim", "slice", F.col("vec_id").asc_nulls_first())

    def best(r: _Shard, query: int, q: np.ndarray) -> list[tuple[float, int]]:
        want = k + 1
        while True:
            near, scored = r.near(q, want, breadth), {}
            for x in near:
                score = -float(np.dot(r.exact[x], q))
                for v in r.ids_of(x):
                    if v != query:
                        scored[v] = min(score, scored.get(v, score))
            if len(scored) >= k or len(near) < want:
                return sorted((s, v) for v, s in scored.items())[:k]
            want *= 2  # repeated ids have taken places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for rows in batches:
            get, out = dict(zip(rows.schema.names, rows.columns, strict=True)), []
            keys = list(zip(*(get[c].to_pylist() for c in ("shard", "dim", "slice")), strict=True))
            for i, query in enumerate(get["vec_id"].to_pylist()):
                if query is None:
                    shard = _Shard(keys[i], {c: get[c][i] for c in ("dim", "ids", "counts", "vectors", "layers", "widths", "entry")})
                elif shard is not None and shard.key == keys[i]:
                    out += [(query, v, -s) for s, v in best(shard, query, np.array(get["embedding"][i].as_py(), np.float64))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Shard:
    """A shard's row of the index, ready to be searched."""

    def __init__(self, key: tuple, row: dict[str, pa.Scalar]):
        self.key, counts = key, np.frombuffer(row["counts"].as_buffer(), np.int32)
        self.ids, self.ends = np.frombuffer(row["ids"].as_buffer(), np.int64), np.cumsum(counts)
        self.firsts = self.ends - counts
        self.exact = np.frombuffer(row["vectors"].as_buffer(), np.float64).reshape(-1, row["dim"].as_py())
        layers = [np.frombuffer(x, np.int32).reshape(-1, w) for x, w in zip(row["layers"].as_py(), row["widths"].as_py(), strict=True)]
        self.graph = Hnsw(self.exact.astype(np.float32), layers, row["entry"].as_py())
        self.seen, self.mark = np.full(len(self.exact), -1, np.int64), 0

    def near(self, q: np.ndarray, k: int, breadth: int) -> list[int]:
        found = self.graph.search(q.astype(np.float32), k, breadth, self.seen, self.mark)
        self.mark += len(self.graph.layers) + 1
        return found

    def ids_of(self, node: int) -> list[int]:
        return self.ids[self.firsts[node] : self.ends[node]].tolist()


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Indexes ``vectors`` (vec_id, embedding) and searches ``queries`` (vec_id, embedding) in it.

    Vectors that are null, zero or hold null or non-finite components take no part, as query or
    candidate; nor do rows without a vec_id. Rows that repeat a vec_id are one query, by its smallest
    vector, and further candidates, of which the best counts. An empty table gives no rows; further
    columns are ignored.
    """
    return search_index(build_index(vectors, k), queries, k)
