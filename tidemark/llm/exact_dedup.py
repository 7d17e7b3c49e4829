"""Exact dedup: Patricia-trie owners in length-and-content-hash partitions."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import put_on_path, text_blocks, turn_to

#: Bytes of distinct text that a trie holds before its largest subtree is given off.
TRIE_BYTES = 48 << 20
#: What a node costs besides its bytes, about.
NODE_BYTES = 300

_PART = "length long, hash long, content binary, keep_id long, group_size long"


def normalised(text: bytes) -> bytes:
    """Each run of the bytes 0x20 and 0x09 to 0x0D as one space; bytes.split() splits at just these."""
    body = b" ".join(text.split())
    if not body:
        return b" " if text else b""
    spaces = b" \t\n\x0b\x0c\r"
    return b" " * (text[0] in spaces) + body + b" " * (text[-1] in spaces)


def smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class PatriciaTrie:
    """A compressed radix trie over byte strings; a terminal node holds the smallest id and the count.

    A node is [label, children by first byte, terminal or None]. ``sizes`` has the bytes below each
    child of the root, so that the largest subtree can be taken out.
    """

    def __init__(self, depth: int = 0):
        self.depth, self.root, self.sizes = depth, ["", {}, None], {}

    def insert(self, text: bytes, keep: int | None, count: int) -> None:
        node, at, first = self.root, self.depth, text[self.depth : self.depth + 1]
        while True:
            if at == len(text):
                break
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = child = [text[at:], {}, None]
                self.sizes[first] = self.sizes.get(first, 0) + len(text) - at + NODE_BYTES
                node, at = child, len(text)
                break
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = common_prefix(label, text[at : at + len(label)])
            middle = [label[:shared], {label[shared]: child}, None]
            child[0] = label[shared:]
            node[1][text[at]] = middle
            self.sizes[first] = self.sizes.get(first, 0) + NODE_BYTES
            node, at = middle, at + shared
        had = node[2]
        node[2] = (keep, count) if had is None else (smaller(had[0], keep), had[1] + count)

    @property
    def size(self) -> int:
        return sum(self.sizes.values())

    def largest(self) -> bytes:
        return max(self.sizes, key=self.sizes.get)

    def take(self, first: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        """Takes the subtree below a child of the root out, as (rest of the text from the depth on, id, count)."""
        self.sizes.pop(first, None)
        stack = [(b"", self.root[1].pop(first[0]))]
        while stack:
            prefix, (label, children, end) = stack.pop()
            prefix += label
            if end is not None:
                yield (prefix, *end)
            stack += [(prefix, c) for c in children.values()]

    def take_all(self) -> Iterator[tuple[bytes, int | None, int]]:
        if self.root[2] is not None:
            yield (b"", *self.root[2])
            self.root[2] = None
        for first in sorted(self.sizes):
            yield from self.take(first)


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:  # by halves: comparing slices is done in C
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def owners(rows: Iterable[tuple[bytes, int | None, int]], budget: int = TRIE_BYTES, depth: int = 0) -> Iterator[tuple[bytes, int | None, int]]:
    """Merges (text, id, count) rows of equal texts; beyond the budget the largest subtree is spilled.

    A spilled subtree goes to a temporary file that is gone with its handle. At the end each
    spilled subtree is merged by itself, below the bytes that all its texts share, and with the same
    budget (or four times the longest text, if that is more). Texts that are equal take the same
    path, so they meet in one subtree.
    """
    trie, files, shared = PatriciaTrie(depth), {}, {}
    prefix, limit = b"", budget

    def spill(first: bytes) -> None:
        for row in trie.take(first):
            if first not in files:
                files[first], shared[first] = tempfile.TemporaryFile(), row[0]
            shared[first] = shared[first][: common_prefix(shared[first], row[0])]
            pickle.dump(row, files[first])

    for text, keep, count in rows:
        prefix, limit = text[:depth], max(limit, 4 * len(text))
        trie.insert(text, keep, count)
        while trie.size > limit:
            spill(trie.largest())
    for first in [f for f in trie.sizes if f in files]:
        spill(first)
    for rest, keep, count in trie.take_all():
        yield prefix + rest, keep, count

    for first, out in files.items():
        with out:
            out.seek(0)

            def read(file=out):
                while True:
                    try:
                        rest, keep, count = pickle.load(file)
                    except EOFError:
                        return
                    yield prefix + rest, keep, count

            yield from owners(read(), budget, depth + len(shared[first]))


def _batches(rows: Iterable[tuple[bytes, int | None, int]]) -> Iterator[pa.RecordBatch]:
    def batch(part: list) -> pa.RecordBatch:
        texts, keeps, counts = zip(*part, strict=True)
        hashes = [int.from_bytes(xxhash.xxh3_64_digest(t), "big", signed=True) for t in texts]
        return pa.RecordBatch.from_arrays([pa.array([len(t) for t in texts], pa.int64()), pa.array(hashes, pa.int64()), pa.array(texts, pa.binary()), pa.array(keeps, pa.int64()), pa.array(counts, pa.int64())], ["length", "hash", "content", "keep_id", "group_size"])

    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[0])
        if size > 1 << 20 or len(part) >= 4096:
            yield batch(part)
            part, size = [], 0
    if part:
        yield batch(part)


def exact_owners(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id (its smallest doc_id), group_size.

    Each task first merges its own rows in a trie and gives subtrees off where the trie is full, so
    a text that fills a third of the table is shuffled once per task. What is left goes to
    partitions by length and content hash, where tries compare the full bytes.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given_off():
            trie = PatriciaTrie()
            for rows, texts in text_blocks(batches, 1):
                for doc_id, text in zip(rows.column(0).to_pylist(), texts, strict=True):
                    trie.insert(normalised(text.encode()), doc_id, 1)
                while trie.sizes and trie.size > trie_bytes:
                    yield from trie.take(trie.largest())
            yield from trie.take_all()

        yield from _batches(given_off())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("texts")
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        part: list = []
        for text, keep, count in owners(rows, trie_bytes):
            part.append((hashlib.sha256(text).digest(), keep, count))
            if len(part) == 4096:
                yield _owner_batch(part)
                part = []
        if part:
            yield _owner_batch(part)

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(combine, _PART)
    dealt = parts.repartition("length", "hash").select("content", "keep_id", "group_size")
    return dealt.mapInArrow(merge, "sha binary, keep_id long, group_size long")


def _owner_batch(part: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["sha", "keep_id", "group_size"])


def exact_dedup(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Which of equal texts stays: doc_id, keep_id, group_size, kept, text_sha256 per row of ``docs``.

    Texts are equal when identical after each run of white space bytes is one space; null counts
    as empty. Of equal texts the row with the smallest doc_id stays. Rows without a doc_id count in
    their group and stay only where the whole group has none; rows that repeat a doc_id and its text
    are kept alike (they can't be told apart). An empty table gives no rows; further columns are ignored.
    """
    put_on_path(docs.sparkSession)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([hashlib.sha256(normalised(t.encode())).digest() for t in texts], pa.binary())], ["doc_id", "sha"])

    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(digests, "doc_id long, sha binary")
    return each.join(exact_owners(docs, trie_bytes), "sha").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
