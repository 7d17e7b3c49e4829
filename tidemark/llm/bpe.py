"""Byte-level BPE encoding and decoding over a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkMemo, Encoded, Numbered
from .common import kept_for, put_on_path, text_blocks

#: Pre-tokens whose ids a worker keeps, about, and the longest of them.
MEMO_PRETOKENS, MEMO_CHARS = 600_000, 64
#: Buckets of so many positions are merged one by one, larger ones by array operations.
FEW = 48
#: Bytes of text of a block, so that many new pre-tokens are merged together; ids whose bytes are laid out at once.
BLOCK, IDS = 1 << 22, 1 << 16


class RankQueue:
    """Positions by merge rank: a bucket per rank, and bitmaps of 64-bit words of which buckets hold any.

    Each level's word has a bit per word of the level below, so the lowest rank is found by one
    find-first-set per level, whatever the number of entries.
    """

    def __init__(self, ranks: int):
        self.levels = []
        n = ranks
        while True:
            n = (n + 63) // 64
            self.levels.append([0] * n)
            if n == 1:
                break
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            had, level[word] = level[word], level[word] | bit
            if had:
                break
            rank = word

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank and its distinct positions, ascending; None when empty."""
        if not self.levels[-1][0]:
            return None
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = (at << 6) + (word & -word).bit_length() - 1
        rank = at
        for level in self.levels:
            word = rank >> 6
            level[word] &= ~(1 << (rank & 63))
            if level[word]:
                break
            rank = word
        bucket = self.buckets.pop(at)
        positions = bucket[0] if len(bucket) == 1 else np.concatenate(bucket)
        if len(positions) > 1:
            positions = np.sort(positions)
            again = positions[1:] == positions[:-1]
            if again.any():
                positions = positions[np.append(True, ~again)]
        return at, positions


class Pieces:
    """Pre-tokens under merging: one linked list of tokens over their bytes, with a break after each pre-token.

    ``token``, ``after``, ``before`` and ``pair`` hold, at the place of a token's first byte, its rank, where the
    next and the previous token of its pre-token start (``n`` and -1: none), and the rank of the
    token that it makes with the next (-1: none). Sixteen bytes a byte of text.
    """

    def __init__(self, data: bytes, ends: np.ndarray, of_byte: np.ndarray, of_pair: np.ndarray):
        raw, n = np.frombuffer(data, np.uint8), len(data)
        self.n, self.token = n, of_byte[raw]
        self.after, self.before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        self.after[ends - 1], self.before[ends[:-1]] = n, -1
        self.pair = np.full(n, -1, np.int32)
        self.pair[:-1] = of_pair[raw[:-1], raw[1:]]
        self.pair[ends - 1] = -1


class BytePairEncoder:
    """Ranks of a byte-level BPE vocabulary; texts are split by ``pattern`` first, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.top = max(ranks.values()) + 1
        self.tokens, self.decimals = Numbered(np.uint8), Numbered(np.uint8)
        for table, texts in ((self.tokens, list(ranks)), (self.decimals, [b"%d," % rank for rank in ranks.values()])):
            table.put(np.fromiter(ranks.values(), np.int64, len(ranks)), (np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))))
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.of_pair = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int32)
        #: Of each pair of tokens that makes a token: left * top + right, and that token's rank.
        self.pairs = {left * self.top + right: rank for token, rank in ranks.items() for at in range(1, len(token)) if (left := ranks.get(token[:at])) is not None and (right := ranks.get(token[at:])) is not None}
        keys, values = np.fromiter(self.pairs.keys(), np.int64, len(self.pairs)), np.fromiter(self.pairs.values(), np.int32, len(self.pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(values[order], np.int32(-1))
        self._forget()
        self.chunks = ChunkMemo(self._each, self._joined)

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.top + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(-1))

    def merge(self, pieces: list[bytes]) -> Encoded:
        """The ids of pre-tokens: the pair of lowest rank merges first, the leftmost among equals.

        All pieces lie in one linked list and share one queue: its order is the order within each
        piece as well, and a rank's bucket is found once for all of them.
        """
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        p = Pieces(b"".join(pieces), ends, self.of_byte, self.of_pair)
        queue = RankQueue(self.top)
        at = np.flatnonzero(p.pair >= 0).astype(np.int32)
        self._push(queue, at, p.pair[at])
        while (found := queue.pop()) is not None:
            rank, positions = found
            rest = self._merge_few(p, queue, rank, positions.tolist()) if len(positions) <= FEW else self._merge_many(p, queue, rank, positions)
            if len(rest):
                queue.push(rank, np.asarray(rest, np.int32))
        alive = p.token >= 0
        return p.token[alive].astype(np.uint32), np.diff(np.cumsum(alive)[ends - 1], prepend=0)

    @staticmethod
    def _push(queue: RankQueue, positions: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        edges = [*np.flatnonzero(np.diff(ranks, prepend=-1)).tolist(), len(ranks)]
        for s, e in pairwise(edges):
            queue.push(int(ranks[s]), positions[s:e])

    def _merge_few(self, p: Pieces, queue: RankQueue, rank: int, positions: list[int]) -> list[int]:
        """Merges the pairs of ``rank`` at ``positions`` in turn; what is left of them once a lower rank has come up."""
        token, after, before, pair, n = *map(memoryview, (p.token, p.after, p.before, p.pair)), p.n
        look, top = self.pairs.get, self.top
        for k, i in enumerate(positions):
            if pair[i] != rank:  # stale: one of the two parts has merged since
                continue
            j = after[i]
            right, left = after[j], before[i]
            token[i], token[j], pair[j], after[i] = rank, -1, -1, right
            lower, new = False, -1
            if right < n:
                before[right] = i
                new = look(rank * top + token[right], -1)
                if new >= 0:
                    queue.push(new, np.array([i], np.int32))
                    lower = new < rank
            pair[i] = new
            if left >= 0:
                pair[left] = new = look(token[left] * top + rank, -1)
                if new >= 0:
                    queue.push(new, np.array([left], np.int32))
                    lower = lower or new < rank
            if lower:  # it comes before the rest of this bucket
                return positions[k + 1 :]
        return []

    def _merge_many(self, p: Pieces, queue: RankQueue, rank: int, positions: np.ndarray) -> np.ndarray:
        """As ``_merge_few``, all at once, or up to the first that brings up a lower rank."""
        i = positions[p.pair[positions] == rank]
        if not len(i):
            return i
        follows = np.append(False, p.after[i[:-1]] == i[1:])  # its left part is the right part of the one before
        if follows.any():  # of a run of overlapping pairs every second one merges
            place = np.arange(len(i))
            i = i[(place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 0]
        j = p.after[i]
        right, left = p.after[j], p.before[i]
        touches = np.append(False, right[:-1] == i[1:])  # its left neighbour is the one merged before
        has_right, has_left = right < p.n, left >= 0
        left = np.where(touches, np.append(np.int32(-1), i[:-1]), left)
        of_left = np.where(touches, rank, p.token[left])
        new_right = np.where(has_right, self._ranks_of(np.full(len(i), rank), p.token[np.where(has_right, right, 0)]), np.int32(-1))
        new_left = np.where(has_left, self._ranks_of(of_left, np.full(len(i), rank)), np.int32(-1))
        lower = ((new_right >= 0) & (new_right < rank)) | ((new_left >= 0) & (new_left < rank))
        rest = i[:0]
        if lower.any():  # it comes before the rest of this bucket
            cut = int(np.argmax(lower)) + 1
            rest = positions[positions > i[cut - 1]]
            i, j, right, left, has_right, has_left, new_right, new_left = (x[:cut] for x in (i, j, right, left, has_right, has_left, new_right, new_left))
        p.token[i], p.token[j], p.pair[j], p.after[i], p.pair[i] = rank, -1, -1, right, new_right
        p.before[right[has_right]] = i[has_right]
        left = left[has_left]
        p.pair[left] = new_left[has_left]
        changed = np.concatenate([i, left])
        ranks = p.pair[changed]
        self._push(queue, changed[ranks >= 0], ranks[ranks >= 0])
        return rest

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.runs = Numbered(np.uint32)

    def _encoded(self, tokens: list[str]) -> Encoded:
        """The ids of pre-tokens, each distinct one merged once."""
        if len(self.memo) > MEMO_PRETOKENS:
            self._forget()
        memo = self.memo
        new = list(dict.fromkeys(t for t in tokens if t not in memo))
        if new:
            at = np.arange(len(memo), len(memo) + len(new))
            memo.update(zip(new, at.tolist(), strict=True))
            whole, apart, pieces = [], [], []
            for k, piece in enumerate(t.encode() for t in new):
                rank = self.ranks.get(piece)
                if rank is None:
                    apart.append(k)
                    pieces.append(piece)
                else:
                    whole.append((k, rank))
            if whole:
                k, ranks = np.array(whole).T
                self.runs.put(at[k], (ranks, np.ones(len(ranks), np.int64)))
            if apart:
                self.runs.put(at[apart], self.merge(pieces))
        out = self.runs.take(np.fromiter(map(memo.__getitem__, tokens), np.int64, len(tokens)))
        if any(len(t) > MEMO_CHARS for t in new):
            self._forget()  # long pre-tokens aren't kept
        return out

    def _each(self, chunks: list[str]) -> Encoded:
        split = list(map(self.pattern.findall, chunks))
        ids, counts = self._encoded(list(chain.from_iterable(split)))
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(ends[np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))], prepend=0)

    def _joined(self, chunks: list[str]) -> Encoded:
        tokens = self.pattern.findall("".join(chunks))
        ids, counts = self._encoded(tokens)
        token_ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        at = np.searchsorted(token_ends, np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks))))
        return ids, np.diff(np.cumsum(counts)[at], prepend=0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, counts = self.chunks.encode(texts)
        return np.split(ids, np.cumsum(counts)[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self._laid_out(self.tokens, ids))

    def digests(self, ids: np.ndarray) -> tuple[str, str]:
        """SHA-256 of the ids in decimal form, joined by commas, and of the bytes that they decode to."""
        of_ids, of_bytes = hashlib.sha256(), hashlib.sha256()
        for k, part in enumerate(self._laid_out(self.decimals, ids)):
            of_ids.update(part[:-1] if k == 0 else b"," + part[:-1])
        for part in self._laid_out(self.tokens, ids):
            of_bytes.update(part)
        return of_ids.hexdigest(), of_bytes.hexdigest()

    @staticmethod
    def _laid_out(table: Numbered, ids: np.ndarray) -> Iterator[bytes]:
        for at in range(0, len(ids), IDS):
            yield table.take(ids[at : at + IDS])[0].tobytes()


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> BytePairEncoder:
    with open(ranks_path, "rb") as f:
        return BytePairEncoder({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}, pattern)


kept_for("bpe", encoder.cache_clear)


def _paths(ranks_path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row of ``docs`` (doc_id, text).

    A null or empty text has no ids; a null doc_id stays null; repeated rows each give a row; an empty
    table gives no rows; further columns are ignored.
    """
    put_on_path(docs.sparkSession)
    path, pattern = _paths(ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_blocks(batches, 1, BLOCK, "bpe"):
            ids = encoder(path, pattern).encode(texts)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id and content (the bytes that the ids stand for) of rows (doc_id, ids); null ids have no bytes."""
    put_on_path(encoded.sparkSession)
    path, pattern = _paths(ranks_path, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                part = rows.slice(at, 256)
                content = [b"" if x is None else encoder(path, pattern).decode(np.array(x, np.uint32)) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, pa.binary())], ["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def round_trip(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes each text, decodes the ids, and returns digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Ids and bytes of a document are digested where they are made and never leave the task. Rows
    as in ``encode_documents``.
    """
    put_on_path(docs.sparkSession)
    path, pattern = _paths(ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for rows, texts in text_blocks(batches, 1, BLOCK, "bpe"):
            n, of_ids, of_bytes = [], [], []
            for ids in coder.encode(texts):
                n.append(len(ids))
                a, b = coder.digests(ids)
                of_ids.append(a)
                of_bytes.append(b)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
