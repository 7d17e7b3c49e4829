"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import put_on_path, text_blocks
from .tokens import WORK, default_tokenizer, ended_ids

SEQUENCE_TOKENS = 1024
#: Documents of a group, on average; a group is what one call packs, whatever the corpus holds.
GROUP_DOCUMENTS = 1024

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, pack_group long"
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (each at most ``capacity``), longest first, ties in the order given.

    The tree is a tournament of the bins' free room: an inner node holds the larger of its two
    children, so the first bin with room enough is found from the root by going left where the
    left child has the room.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def cut(docs: DataFrame, tokenizer_path: str, capacity: int, keep_ids: bool) -> DataFrame:
    """Each document's ids with the end id, cut into pieces of ``capacity`` and a rest; of ``docs`` (doc_id, text, pack_group).

    A null or empty text is one piece, the end id; repeated rows are cut each; an empty table gives no rows.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_blocks(batches, 1, work=WORK):
            ids, groups = rows.column(0).to_pylist(), rows.column(2).to_pylist()
            out: list[tuple] = []
            for doc_id, group, data in zip(ids, groups, ended_ids(tokenizer_path, texts), strict=True):
                for at in range(0, len(data), 4 * capacity):
                    part = data[at : at + 4 * capacity]
                    out.append((doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(data) // 4, group, *([part] if keep_ids else [])))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pack_group", *(["ids"] if keep_ids else [])]
            kinds = [pa.int64()] * 6 + [pa.binary()] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.mapInArrow(pieces, _PIECES + ", ids binary" * keep_ids)


def pack(docs: DataFrame, *, capacity: int = SEQUENCE_TOKENS, group_documents: int = GROUP_DOCUMENTS, tokenizer_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Packs the documents of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, start (the document's ids before it), length, ids_crc32,
    doc_tokens, sequence_id and offset (gapless from 0 within a sequence); with ``keep_ids``
    also the piece's ids as little-endian unsigned 32-bit integers. Every id is in one piece.

    Groups are drawn by a hash of the row and its place in the table, so copies, repeated rows and rows of
    one source spread, and one call sees about ``group_documents`` documents at any corpus size. Places
    must not change when a task is run again: ``docs`` are read from files or a written table. A null or empty text is
    the end id alone; a null doc_id stays null; rows that repeat are packed as often as they come;
    an empty table gives no rows; further columns of ``docs`` are ignored.
    """
    put_on_path(docs.sparkSession)
    path = tokenizer_path or default_tokenizer()
    groups = max(1, -(-docs.count() // group_documents))
    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(groups)).alias("pack_group"))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group.drop(columns="pack_group").assign(sequence_id=(group["pack_group"].to_numpy() << 32) + bins, offset=offsets)

    schema = _SCHEMA + ", ids binary" * keep_ids

    def typed(group: pd.DataFrame) -> pd.DataFrame:
        return place(group).astype({"doc_id": "Int64"})

    return cut(rows, path, capacity, keep_ids).groupBy("pack_group").applyInPandas(typed, schema)
