"""Exact memoised encoding: texts are cut where no pre-token can cross, and each chunk is encoded once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

#: Chunks and encoded items that a worker keeps; beyond either it starts anew.
CACHE_CHUNKS, CACHE_ITEMS = 1_000_000, 8_000_000
#: Longer chunks are encoded each time they come.
CACHE_CHARS = 48

#: What an encoder returns: the items of all its inputs in one array, and how many each input has.
Encoded = tuple[np.ndarray, np.ndarray]


class Numbered:
    """Runs of items in one growing array, found by number."""

    def __init__(self, kind: np.dtype, width: int = 1):
        self.items = np.empty((1024, width) if width > 1 else 1024, kind)
        self.starts, self.counts = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.used = 0

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        out = np.zeros((max(n, 2 * len(a)), *a.shape[1:]), a.dtype)
        out[: len(a)] = a
        return out

    def put(self, numbers: np.ndarray, encoded: Encoded) -> None:
        items, counts = encoded
        top = int(numbers.max()) + 1
        self.starts, self.counts = self._grown(self.starts, top), self._grown(self.counts, top)
        self.items = self._grown(self.items, self.used + len(items))
        self.items[self.used : self.used + len(items)] = items
        self.starts[numbers], self.counts[numbers] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(items)

    def take(self, numbers: np.ndarray) -> Encoded:
        """The runs of ``numbers`` one after the other, and their lengths."""
        counts = self.counts[numbers]
        at = np.repeat(self.starts[numbers] - (np.cumsum(counts) - counts), counts)
        at += np.arange(len(at))
        return self.items[at], counts


class _Numbers(dict):
    """Numbers of strings; an unknown one gets the next number and is noted in ``new``."""

    def __init__(self, counter: list[int], longest: int, unsafe: bool):
        super().__init__()
        self.counter, self.longest, self.unsafe = counter, longest, unsafe
        self.new: list[str] = []
        self.new_numbers: list[int] = []

    def __missing__(self, piece: str) -> int:
        if self.unsafe and (not piece or piece[0].isspace() or piece[-1].isspace()):
            self[piece] = 0
            return 0
        number = self.add(piece)
        if len(piece) <= self.longest:
            self[piece] = number
        return number

    def add(self, piece: str) -> int:
        number = self.counter[0]
        self.counter[0] += 1
        self.new.append(piece)
        self.new_numbers.append(number)
        return number

    def fresh(self) -> tuple[list[str], np.ndarray]:
        out = self.new, np.array(self.new_numbers, np.int64)
        self.new, self.new_numbers = [], []
        return out


class ChunkMemo:
    """Encodes texts chunk by chunk through ``encode_many(list of str) -> Encoded``.

    A chunk is a space and what follows up to the next space. The byte-level pre-token pattern
    attaches one space to what follows it and never lets a match run from a non-space over a
    space, so a cut before a space is exact where both neighbours of the space are no white
    space. Elsewhere neighbouring pieces are joined to one chunk first. ``encode_joined``, where
    given, gets chunks that may be encoded as the one text they make together, as no pre-token
    crosses from one to the next.
    """

    def __init__(self, encode_many: Callable[[list[str]], Encoded], encode_joined: Callable[[list[str]], Encoded] | None = None, kind: type = np.uint32, width: int = 1):
        self.encode_many, self.encode_joined, self.kind, self.width = encode_many, encode_joined or encode_many, kind, width
        self._clear()

    def _clear(self) -> None:
        counter = [1]  # 0: a piece with white space at an edge
        self.pieces, self.heads = _Numbers(counter, CACHE_CHARS, True), _Numbers(counter, CACHE_CHARS, False)
        self.runs = Numbered(self.kind, self.width)

    def numbers(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Each text's chunks, without their leading space but for the first, which has none; the numbers of all chunks; chunks per text."""
        if self.pieces.counter[0] > CACHE_CHUNKS or self.runs.used > CACHE_ITEMS:
            self._clear()
        pieces, heads = self.pieces, self.heads
        split = [t.split(" ") for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        found = np.fromiter(map(pieces.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        firsts = np.cumsum(counts) - counts
        found[firsts] = [heads[p[0]] for p in split]
        unsafe = set(np.searchsorted(firsts, np.flatnonzero(found == 0), "right") - 1)
        unsafe.update(k for k, p in enumerate(split) if len(p) > 1 and p[0] and p[0][-1].isspace())
        if unsafe:
            parts, at = [], 0
            for k in sorted(map(int, unsafe)):
                chunks = joined(split[k])
                own = [heads[chunks[0]], *(pieces.get(c) or pieces.add(c) for c in chunks[1:])]
                parts += [found[at : firsts[k]], np.array(own, np.int64)]
                at, split[k] = firsts[k] + counts[k], chunks
            parts.append(found[at:])
            for k in unsafe:
                counts[k] = len(split[k])
            found = np.concatenate(parts)
        new, at = pieces.fresh()
        apart = np.fromiter((p[-1:].isspace() or p[:1].isspace() or " " in p for p in new), bool, len(new))
        for chosen, encode in ((~apart, self.encode_joined), (apart, self.encode_many)):
            if chosen.any():
                self.runs.put(at[chosen], encode([" " + p for p, c in zip(new, chosen.tolist(), strict=True) if c]))
        new, at = heads.fresh()
        if new:
            self.runs.put(at, self.encode_many(new))
        return split, found, counts

    def encode(self, texts: list[str]) -> Encoded:
        """The items of all texts in one array, and how many each text has."""
        _, numbers, counts = self.numbers(texts)
        items, lengths = self.runs.take(numbers)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return items, np.diff(ends)


def joined(pieces: list[str]) -> list[str]:
    """Joins pieces over the spaces that have white space beside them; at the start of a text a cut is always exact."""
    chunks = [pieces[0]]
    for i, p in enumerate(pieces[1:], 1):
        before = pieces[i - 1]
        start = i == 1 and not before
        if p and not p[0].isspace() and (start or (before and not before[-1].isspace())):
            chunks.append(p)
        elif start:
            chunks.append(p)
        else:
            chunks[-1] += " " + p
    return chunks
