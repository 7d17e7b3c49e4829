"""Source divergence audit: how far each source's vocabulary lies from the others of its language.

Terms that many sources of a language use are heavy: they are compared in dense numpy tiles (sources x
terms). The others are light. Every pair starts from the distance of the two sources' values at count 0, for
all terms; tiles add what is different for their terms, and posting lists what is for light ones: first for
each posting against the other source's value at 0, then for the pairs of sources that share a term. All
values are whole numbers, so the partial sums add up exactly, in whatever order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import put_on_path, written
from .words import LETTERS, byte_blocks, strings, words

#: Documents of a language that a kept term occurs in at least; added to each count; p is in billionths.
LEAST_DOCUMENTS, PRIOR, UNIT = 30, 5, 1_000_000_000
#: Terms reported per source.
TOP_TERMS = 50
#: A term is heavy when at least one in so many sources of its language uses it.
HEAVY_SHARE = 4
#: Values of a dense tile and postings of a light one, about; sources of a block, about.
TILE, BLOCK_SOURCES = 4096, 512
#: Distinct (source, term) entries that a task holds before it sends them on.
HELD_TERMS = 200_000
#: Languages and sources (some 100 bytes each) up to which their totals are broadcast; beyond it they are joined by shuffles.
BROADCAST_GROUPS = 100_000

_COUNTS = "lang string, source string, term string, n long, docs long"
_PAIRS = "lang string, a string, b string, value long"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, summed per task and then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), strings(list(n)), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for block, texts in byte_blocks(batches, 2):
            for lang, source, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), texts, strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for part in words(text, LETTERS):
                    n.update(part)
                    seen.update(part)
                docs.update(seen)
            if sum(len(n) for n, _ in held.values()) >= HELD_TERMS:
                yield from rows()
        yield from rows()

    counted = docs.select(_named("lang"), _named("source"), "text").mapInArrow(run, _COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_GROUPS else df


def _value(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)), in decimals of 38 places as counts have no bound."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * cast({count} + {PRIOR} as decimal(20,0))) div cast({total} + {PRIOR} * {terms} as decimal(20,0))")


@dataclass
class _Block:
    """The partial sums of the pairs of two blocks of sources."""

    names: list[str]
    zero: np.ndarray  # a source's value at count 0
    block: np.ndarray
    terms: int
    total: np.ndarray

    @classmethod
    def of(cls, headers: pa.Table) -> _Block:
        headers = headers.sort_by("source")  # each pair has one order in all tasks
        names = headers.column("source").to_pylist()
        return cls(names, headers.column("p").to_numpy(), headers.column("block").to_numpy(), headers.column("m")[0].as_py(), np.zeros((len(names), len(names)), np.int64))

    def add_tile(self, at: np.ndarray, term: np.ndarray, p: np.ndarray) -> None:
        """Dense: every source's value of every term of the tile that these sources use."""
        dense = np.repeat(self.zero[:, None], term.max() + 1, axis=1)
        dense[at, term] = p
        for i in range(len(dense) - 1):
            self.total[i, i + 1 :] += np.abs(dense[i + 1 :] - dense[i]).sum(axis=1) - dense.shape[1] * np.abs(self.zero[i + 1 :] - self.zero[i])

    def add_shared(self, at: np.ndarray, term: np.ndarray, p: np.ndarray) -> None:
        """Sparse: what pairs of sources that share a light term add to the sums of each alone."""
        order = np.lexsort((at, term))
        at, term, p = at[order], term[order], p[order]
        for lag in range(1, len(at)):
            first = np.flatnonzero(term[lag:] == term[:-lag])
            if not len(first):
                break
            a, b = at[first], at[first + lag]
            pa_, pb, za, zb = p[first], p[first + lag], self.zero[a], self.zero[b]
            np.add.at(self.total, (a, b), np.abs(pa_ - pb) - np.abs(pa_ - zb) - np.abs(za - pb) + np.abs(za - zb))

    def add_alone(self, at: np.ndarray, p: np.ndarray, m: np.ndarray) -> None:
        """All terms at 0 for both sources; sparse: each source's light postings (value p, m times) against the other's value at 0."""
        away = np.abs(self.zero[:, None] - self.zero[None, :])
        alone = np.zeros_like(self.total)
        for i in np.unique(at).tolist():
            own = at == i
            order = np.argsort(p[own])
            values, times = p[own][order], m[own][order]
            n, s = np.concatenate([[0], np.cumsum(times)]), np.concatenate([[0], np.cumsum(values * times)])
            k = np.searchsorted(values, self.zero)
            below, above = self.zero * n[k] - s[k], (s[-1] - s[k]) - self.zero * (n[-1] - n[k])
            alone[i] += below + above - n[-1] * away[i]
        self.total += np.triu(self.terms * away + alone + alone.T, 1)

    def rows(self, lang: str, low: int, high: int) -> pa.RecordBatch:
        i, j = np.triu_indices(len(self.names), 1)
        if low != high:
            i, j = (x[self.block[i] != self.block[j]] for x in (i, j))
        names = pa.array(self.names, pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), names.take(pa.array(i)), names.take(pa.array(j)), pa.array(self.total[i, j])], ["lang", "a", "b", "value"])


#: Kinds of rows in a tile: a source of the blocks (p: at count 0, m: terms of the lang), a heavy or a light posting, or light postings of one value (m: how many).
_HEADER, _HEAVY, _LIGHT, _ALONE = range(4)
_TILED = ["lang", "low", "high", "tile", "kind", "source", "block", "term", "p", "m"]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (lang, low, high, tile, kind); a tile is held at once, and the sums of a pair of blocks over all its tiles here."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    sums: _Block | None = None

    def add() -> None:
        nonlocal sums
        tile = pa.Table.from_batches(held)
        kind = tile.column("kind").to_numpy()
        cut = np.searchsorted(kind, [_HEADER, _HEAVY, _LIGHT, _ALONE, _ALONE + 1])
        parts = [tile.slice(s, e - s) for s, e in zip(cut[:-1], cut[1:], strict=True)]
        sums = sums or _Block.of(parts[_HEADER])
        place = pa.array(sums.names, pa.string())
        for k in (_HEAVY, _LIGHT, _ALONE):
            rows = parts[k]
            if k == _ALONE and now[3] < 0:
                sums.add_alone(*(np.zeros(0, np.int64),) * 3 if not rows.num_rows else (_places(rows, place), rows.column("p").to_numpy(), rows.column("m").to_numpy()))
            elif rows.num_rows:
                term = rows.column("term").combine_chunks().dictionary_encode()
                term = (term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term).indices.to_numpy(zero_copy_only=False).astype(np.int64)
                (sums.add_tile if k == _HEAVY else sums.add_shared)(_places(rows, place), term, rows.column("p").to_numpy())

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
        start = 0
        for i, key in enumerate([*keys, None]):
            if key == now and key is not None:
                continue
            if i > start:
                held.append(batch.slice(start, i - start))
            if key is None:
                break
            if held:
                add()
                if key[:3] != now[:3]:
                    yield sums.rows(*now[:3])
                    sums = None
            held, start, now = [], i, key
    if held:
        add()
        yield sums.rows(*now[:3])


def _places(rows: pa.Table, names: pa.Array) -> np.ndarray:
    return pc.index_in(rows.column("source").combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)


def _pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of each pair of sources of a language: the sum of the absolute differences of their values over all kept terms."""
    last = F.col("last_block")
    own = F.pmod(F.xxhash64("source"), last + 1).cast("int")
    over = F.explode(F.sequence(F.lit(0), last))
    laid = lambda df: (
        df.withColumn("block", own).withColumn("other", over).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    )
    none = F.lit(None).cast("string")
    tiles = F.explode(F.sequence(F.lit(-1), F.col("heavy_tiles") + F.col("light_tiles") - 1))
    headers = laid(groups).withColumn("tile", tiles).select("lang", "low", "high", "tile", F.lit(_HEADER).alias("kind"), "source", "block", none.alias("term"), F.col("zero").alias("p"), F.col("terms").alias("m"))
    spread = lambda c: F.pmod(F.xxhash64("term"), F.greatest(c, F.lit(1))).cast("int")
    tile = F.when(F.col("heavy"), spread(F.col("heavy_tiles"))).otherwise(F.col("heavy_tiles") + spread(F.col("light_tiles")))
    postings = laid(kept.where("p <> zero")).select("lang", "low", "high", tile.alias("tile"), F.when(F.col("heavy"), _HEAVY).otherwise(_LIGHT).alias("kind"), "source", "block", "term", "p", F.lit(1).cast("long").alias("m"))
    values = kept.where("not heavy and p <> zero").groupBy("lang", "source", "p").agg(F.count("*").alias("m"), F.first("last_block").alias("last_block"))
    alone = laid(values).select("lang", "low", "high", F.lit(-1).alias("tile"), F.lit(_ALONE).alias("kind"), "source", "block", none.alias("term"), "p", "m")
    rows = headers.unionByName(postings).unionByName(alone).select(_TILED)
    keys = ["lang", "low", "high", "tile"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(_summed, _PAIRS).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """The divergence report of ``docs`` (text, lang, source): lang, source, part, item, value, rank.

    A language keeps the terms in at least ``least_documents`` of its documents. Part ``pair`` has, for each
    two sources of a language, the sum over kept terms of the absolute difference of their smoothed shares
    in billionths; part ``term`` each source's ``top_terms`` terms whose share is most above the language's.

    Null text, lang and source are the empty string. A source without kept terms is compared at count 0; a
    language with one source has no pairs, one without kept terms has sums of 0. Ties rank by the item's bytes;
    repeated rows count each; an empty table gives no rows; further columns are ignored.
    """
    put_on_path(docs.sparkSession)
    groups = docs.select(_named("lang"), _named("source")).distinct()
    term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumn("in_docs", F.sum("docs").over(term)).withColumn("in_lang", F.sum("n").over(term)).withColumn("holders", F.count("*").over(term))
    counts = counts.withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
    kept = written(counts.where(F.col("in_docs") >= least_documents).select("lang", "source", "term", "n", "in_lang", "holders", "first"), "terms")
    groups = written(groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n_source")), ["lang", "source"], "left").fillna({"n_source": 0}), "groups")
    n_groups = groups.count()

    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("n_source").alias("n_lang"))
    heavy = F.col("holders") * HEAVY_SHARE >= F.col("sources")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    terms = kept.groupBy("lang", "holders").agg(one(F.col("first")).alias("terms"), F.count("*").alias("postings"))
    sized = (
        sources.join(terms, "lang", "left").fillna({"terms": 0, "postings": 0, "holders": 0}).groupBy("lang", "sources", "n_lang")
        .agg(F.sum("terms").alias("terms"), F.sum(F.when(heavy, F.col("terms")).otherwise(0)).alias("heavy_terms"), F.sum(F.when(heavy, 0).otherwise(F.col("postings"))).alias("light_postings"))
    )
    tiles = lambda cells: F.ceil(cells / TILE).cast("int")
    sized = sized.select(
        "lang", "n_lang", "terms", "sources", (F.ceil(F.col("sources") / BLOCK_SOURCES) - 1).cast("int").alias("last_block"),
        tiles(F.col("heavy_terms") * F.least("sources", F.lit(2 * BLOCK_SOURCES))).alias("heavy_tiles"), tiles(F.col("light_postings")).alias("light_tiles"),
    )
    zero = F.when(F.col("terms") > 0, _value("0", "n_source", "terms")).otherwise(0).alias("zero")
    groups = written(groups.join(_small(sized, n_groups), "lang").select("*", zero), "groups")
    valued = kept.join(_small(groups, n_groups), ["lang", "source"]).withColumn("p", _value("n", "n_source", "terms")).withColumn("q", _value("in_lang", "n_lang", "terms")).withColumn("heavy", heavy)

    pairs = _pair_sums(valued, groups)
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.*", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = valued.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(both.withColumn("rank", F.row_number().over(order)), "pair").unionByName(out(above, "term"))
