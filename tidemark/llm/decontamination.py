"""Benchmark decontamination: an FM-index per training shard finds the windows of test items in whole texts.

A task lays its documents over shards of about ``SHARD_WORDS`` words; a longer text goes on in the next
shard, which begins with its last words once more. The windows of the items are searched backward in
each shard, their occurrences located by sampled places, and the words that they cover merged to spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import put_on_path, written
from .fm_index import FMIndex
from .words import LETTERS_AND_DIGITS, byte_blocks, words

WINDOW_WORDS = 10
#: Words of a shard, and windows with their items that are searched at once (some 200 bytes each, broadcast).
SHARD_WORDS, WINDOWS_AT_ONCE = 1 << 20, 200_000
#: Occurrences that are located at once.
LOCATED_AT_ONCE = 1 << 18

_SPANS = "array<struct<start: long, end: long>>"
_FOUND = f"row long, doc_id long, n_words long, spans {_SPANS}, items array<long>"
_INDEX = "rows array<long>, doc_ids array<long>, firsts array<long>, lengths array<long>, overlaps array<long>, vocabulary binary, fm binary"


@dataclass
class Parts:
    """Pieces of documents in one shard: the row, its doc_id, the piece's first word in the document, its words, and how many of these the shard before had too."""

    rows: list[int] = field(default_factory=list)
    doc_ids: list[int | None] = field(default_factory=list)
    firsts: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    overlaps: list[int] = field(default_factory=list)

    def add(self, row: int, doc_id: int | None, first: int, overlap: int) -> None:
        for x, v in zip((self.rows, self.doc_ids, self.firsts, self.lengths, self.overlaps), (row, doc_id, first, overlap, overlap), strict=True):
            x.append(v)


class _Numbers(dict):
    """Words of a shard, numbered from 1 as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


Shard = tuple[Parts, "dict[bytes, int]", FMIndex]


def shards(batches: Iterator[pa.RecordBatch], overlap: int, size: int) -> Iterator[Shard]:
    """The shards of rows (row, doc_id, text), each with its words' numbers and index."""
    parts, numbers, text, n = Parts(), _Numbers(), [], 0

    def closed() -> Shard:
        return parts, dict(numbers), FMIndex.of(np.concatenate(text))

    end = np.zeros(1, np.int32)
    for block, texts in byte_blocks(batches, 2):
        for row, doc_id, data in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), texts, strict=True):
            parts.add(row, doc_id, 0, 0)
            done, tail = 0, []
            for found in words(data, LETTERS_AND_DIGITS):
                at = 0
                while at < len(found):
                    if n >= size:
                        yield _ended(closed, text, end)
                        parts, numbers, text = Parts(), _Numbers(), []
                        parts.add(row, doc_id, done - len(tail), len(tail))
                        text.append(np.fromiter(map(numbers.__getitem__, tail), np.int32, len(tail)))
                        n = len(tail)
                    taken = found[at : at + max(1, size - n)]
                    text.append(np.fromiter(map(numbers.__getitem__, taken), np.int32, len(taken)))
                    at, n, done = at + len(taken), n + len(taken), done + len(taken)
                    parts.lengths[-1] += len(taken)
                    tail = (tail + taken[-overlap:])[-overlap:] if overlap else []
            text.append(end)
            n += 1
            if n >= size:
                yield closed()
                parts, numbers, text, n = Parts(), _Numbers(), [], 0
    if text:
        yield closed()


def _ended(closed: Callable[[], Shard], text: list[np.ndarray], end: np.ndarray) -> Shard:
    text.append(end)
    return closed()


@dataclass
class Windows:
    """Windows by their number of words, each with the items that have it."""

    by_length: dict[int, tuple[list[list[bytes]], list[list[int]]]]

    @classmethod
    def of(cls, rows: list) -> Windows:
        by: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
        for window, item in rows:
            key = tuple(window.encode().split(b" "))
            items = by.setdefault(len(key), {}).setdefault(key, [])
            if item is not None:
                items.append(item)
        return cls({n: ([list(k) for k in found], list(found.values())) for n, found in by.items()})


def search(shard: Shard, windows: Windows) -> Iterator[tuple]:
    """A row (row, doc_id, new words, spans of words, items) of each part of a shard; spans are disjoint and in order."""
    parts, numbers, index = shard
    lengths = np.array(parts.lengths, np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    size = int(starts[-1] + lengths[-1] + 1)
    cover = np.zeros(size + 1, np.int64)
    items: list[set[int]] = [set() for _ in parts.rows]
    for n, (found, of) in windows.by_length.items():
        numbered = [(i, [numbers.get(w, 0) for w in window]) for i, window in enumerate(found)]
        numbered = [(i, x) for i, x in numbered if 0 not in x]
        if not numbered:
            continue
        low, high = index.search(np.array([x for _, x in numbered], np.int64))
        which = np.repeat(np.array([i for i, _ in numbered]), high - low)
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange(len(which))
        for s in range(0, len(rows), LOCATED_AT_ONCE):
            at = index.locate(rows[s : s + LOCATED_AT_ONCE])
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n, -1)
            part = np.searchsorted(starts, at, side="right") - 1
            for p, i in np.unique(np.stack([part, which[s : s + LOCATED_AT_ONCE]], axis=1), axis=0).tolist():
                items[p].update(of[i])
    hit = (np.cumsum(cover[:-1]) > 0).astype(np.int8)
    change = np.flatnonzero(np.diff(hit, prepend=0, append=0)).reshape(-1, 2)  # no span runs over an end
    of_part = np.searchsorted(starts, change[:, 0], side="right") - 1
    spans: list[list[dict[str, int]]] = [[] for _ in parts.rows]
    for p, (s, e) in zip(of_part.tolist(), (change - starts[of_part, None]).tolist(), strict=True):
        spans[p].append({"start": s + parts.firsts[p], "end": e + parts.firsts[p]})
    yield from zip(parts.rows, parts.doc_ids, (lengths - np.array(parts.overlaps)).tolist(), spans, map(sorted, items), strict=True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), span, pa.list_(pa.int64())), strict=True)], ["row", "doc_id", "n_words", "spans", "items"])


def item_windows(items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """(window, item_id): the distinct windows of each item, words joined by a space; an item of fewer words is one window."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = items.select(F.col("item_id").cast("long").alias("item_id"), F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)).alias("words"))
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1))))
    return found.where(F.size("words") > 0).select("item_id", "words", at.alias("at")).select(F.array_join(F.slice("words", F.col("at"), size), " ").alias("window"), "item_id").distinct()


def build_index(docs: DataFrame, overlap: int, size: int) -> DataFrame:
    """A row per shard: the parts in it, its vocabulary and its index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, numbers, index in shards(batches, overlap, size):
            columns = [pa.array([x], pa.list_(pa.int64())) for x in (parts.rows, parts.doc_ids, parts.firsts, parts.lengths, parts.overlaps)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([b" ".join(numbers)], pa.binary()), pa.array([index.to_bytes()], pa.binary())], [x.split()[0] for x in _INDEX.split(", ")])

    return docs.mapInArrow(run, _INDEX)


def search_index(index: DataFrame, windows: Windows) -> DataFrame:
    """What ``search`` gives of the shards of a written index."""
    held = index.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                *columns, vocabulary, fm = (c[i].as_py() for c in batch.columns)
                yield _batch(list(search((Parts(*columns), {w: k for k, w in enumerate(vocabulary.split(b" "), 1)}, FMIndex.from_bytes(fm)), held.value)))

    return index.mapInArrow(run, _FOUND)


def _searched(docs: DataFrame, windows: Windows, overlap: int, size: int) -> DataFrame:
    """What ``search`` gives of shards that are built for this one search."""
    held = docs.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, overlap, size):
            yield _batch(list(search(shard, held.value)))

    return docs.mapInArrow(run, _FOUND)


def _merged(spans: Column) -> Column:
    """Spans in order, those that overlap or adjoin made one."""
    last = lambda acc: F.element_at(acc, -1)
    join = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))))
    step = lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]), join(acc, s)).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), step)


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS, shard_words: int = SHARD_WORDS, windows_at_once: int = WINDOWS_AT_ONCE) -> DataFrame:
    """Where windows of ``items`` (item_id, text) occur in ``docs`` (doc_id, text): row, doc_id, n_words, spans, items.

    Words are maximal runs of ASCII letters, lower-cased, digits and code points from 0x80 on. A window is
    ``size`` consecutive words of an item, or all of a shorter one. ``spans`` are the numbers of the covered
    words (end exclusive), in order and disjoint; ``items`` the sorted item_ids with an occurring window; ``row``
    numbers the rows of ``docs``. Null and empty texts have no words; repeated rows give a row each; a null
    doc_id stays null; items without words have no window, an item without an item_id covers words but isn't
    listed, rows that repeat an item_id are one item. Empty docs give no rows, empty items no spans; further
    columns are ignored.

    Windows are counted first. Up to ``windows_at_once`` they are broadcast, and each shard is searched when
    its index is made. More are dealt to blocks of that size; the indexes are then written once and searched
    for one block after the other.
    """
    return _found(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), items, size, shard_words, windows_at_once)


def _found(rows: DataFrame, items: DataFrame, size: int, shard_words: int, windows_at_once: int) -> DataFrame:
    put_on_path(rows.sparkSession)
    windows = written(item_windows(items, size), "windows")
    blocks = max(1, -(-windows.count() // windows_at_once))
    block = lambda b: Windows.of(windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b).collect())
    if blocks == 1:
        found = _searched(rows, block(0), size - 1, shard_words)
    else:
        index = written(build_index(rows, size - 1, shard_words), "index")
        found = search_index(index, block(0))
        for b in range(1, blocks):
            found = found.union(search_index(index, block(b)).withColumn("n_words", F.lit(0).cast("long")))
    # texts of one shard, as most are, bring one row, already merged
    by_row = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.count("*").alias("n"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    several = F.col("n") > 1
    return by_row.select("row", "doc_id", "n_words", F.when(several, _merged(F.col("spans"))).otherwise(F.col("spans")).alias("spans"), F.when(several, F.array_sort(F.array_distinct("items"))).otherwise(F.col("items")).alias("items"))


def contamination_report(found: DataFrame) -> DataFrame:
    """Per document of ``contamination``: doc_id, n_words, n_hit, n_items, items_sha256 (of the ids, sorted as strings) and contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def without_spans(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` without the covered words, from the first to the last of each span; columns and other rows stay as they are.

    n_chars follows the new text, where there is such a column. A null text stays null.
    """
    row, spans = _new_name(docs, "row"), _new_name(docs, "spans")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = _found(numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), items, size, SHARD_WORDS, WINDOWS_AT_ONCE)
    found = found.where(F.size("spans") > 0).select(F.col("row").alias(row), F.col("spans").alias(spans))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, s) for t, s in zip(texts, found, strict=True)], dtype=object)

    out = numbered.join(found, row, "left")
    hit = F.col(spans).isNotNull()
    out = out.withColumn("text", F.when(hit, cut("text", F.coalesce(spans, F.array().cast(_SPANS)))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def _cut(text: str | None, spans: list[dict[str, int]]) -> str | None:
    if text is None or not len(spans):
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    at, out = 0, []
    for s in spans:
        out.append(text[at : places[s["start"]][0]])
        at = places[s["end"] - 1][1]
    return "".join([*out, text[at:]])


def _new_name(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name = f"_{name}"
    return name
