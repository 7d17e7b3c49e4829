"""An FM-index over the words of a shard: suffix order, wavelet-tree ranks, backward search, sampled positions.

A text is a row of numbers: 0 ends a document, words are 1 and up. Ends sort by their place, so no common
prefix of suffixes runs over an end, and no walk passes one: each document's first position is sampled.
"""

from __future__ import annotations

import io

import numpy as np

#: A walk from an occurrence meets a sampled position after fewer steps than this.
SAMPLE_EVERY = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of ``text`` in order, by doubling the compared length; only ties are sorted again."""
    ends = text == 0
    numbers = text.astype(np.int64) + np.count_nonzero(ends)
    numbers[ends] = np.arange(np.count_nonzero(ends))
    n, bits = len(text), int(numbers.max(initial=1)).bit_length()
    taken = min(63 // bits, n)
    key = np.zeros(n, np.int64)
    for i in range(taken):
        key <<= bits
        key[: n - i] |= numbers[i:]
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(n, np.int64)
    head = np.concatenate([[True], key[1:] != key[:-1]])
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tied = np.flatnonzero(~(head & np.concatenate([head[1:], [True]])))
    while len(tied):
        at = order[tied]
        key = (rank[at] << 32) | rank[at + taken]  # ties have `taken` words in common and so no end among them
        again = np.argsort(key)
        at, key = at[again], key[again]
        order[tied] = at
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = np.maximum.accumulate(np.where(head, tied, 0))
        tied = tied[~(head & np.concatenate([head[1:], [True]]))]
        taken *= 2
    return order


class _Bits:
    """A row of bits with ranks."""

    def __init__(self, words: np.ndarray, before: np.ndarray, zeros: int):
        self.words, self.before, self.zeros = words, before, zeros

    @classmethod
    def of(cls, bits: np.ndarray) -> _Bits:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        before = np.zeros(len(words), np.int32)
        np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
        return cls(words, before, len(bits) - int(np.count_nonzero(bits)))

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many bits before each place are set."""
        low = np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


class FMIndex:
    """``search`` finds the suffix interval of phrases, ``locate`` the text places of an interval's rows.

    The levels of the wavelet tree lie one after another as rows of bits, zeros before ones (a wavelet
    matrix), highest bit first.
    """

    def __init__(self, levels: list[_Bits], first: np.ndarray, sampled: _Bits, places: np.ndarray):
        self.levels, self.first, self.sampled, self.places = levels, first, sampled, places

    @classmethod
    def of(cls, text: np.ndarray) -> FMIndex:
        """The index of a text that ends with 0 and is no longer than 2**31."""
        order = suffix_order(text)
        before = text[order - 1]  # of the first suffix: the end
        first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        levels = []
        for shift in range(int(text.max(initial=0)).bit_length() - 1, -1, -1):
            bit = (before >> shift & 1).astype(bool)
            levels.append(_Bits.of(bit))
            before = np.concatenate([before[~bit], before[bit]])
        starts = np.zeros(len(text), bool)
        starts[::SAMPLE_EVERY] = True
        starts[0] = True
        starts[1:] |= text[:-1] == 0
        marked = starts[order]
        return cls(levels, first, _Bits.of(marked), order[marked].astype(np.int32))

    def _rank(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each word comes in the first ``at`` places before suffixes, in order."""
        start, end = np.zeros_like(at), at
        for i, bits in enumerate(self.levels):
            one = word >> (len(self.levels) - 1 - i) & 1 > 0
            s, e = bits.ones(start), bits.ones(end)
            start, end = np.where(one, bits.zeros + s, start - s), np.where(one, bits.zeros + e, end - e)
        return end - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of each row of ``phrases`` (phrases x words), from its last word backward; without occurrence it is empty."""
        last = phrases[:, -1]
        low, high = self.first[last], self.first[last + 1]
        alive = np.arange(len(phrases))
        for i in range(phrases.shape[1] - 2, -1, -1):
            alive = alive[low[alive] < high[alive]]
            word = phrases[alive, i]
            low[alive], high[alive] = (self.first[word] + self._rank(word, x[alive]) for x in (low, high))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text place of each row of the suffix order: steps to the word before, until a sampled place."""
        place, steps, at, open_ = np.empty(len(rows), np.int64), 0, rows, np.arange(len(rows))
        while len(open_):
            done = self.sampled.get(at)
            place[open_[done]] = self.places[self.sampled.ones(at[done])] + steps
            open_, at, steps = open_[~done], at[~done], steps + 1
            at = self._step(at)
        return place

    def _step(self, at: np.ndarray) -> np.ndarray:
        start, word = np.zeros_like(at), np.zeros_like(at)
        for bits in self.levels:
            one = bits.get(at)
            s, e = bits.ones(start), bits.ones(at)
            start, at = np.where(one, bits.zeros + s, start - s), np.where(one, bits.zeros + e, at - e)
            word = word << 1 | one
        return self.first[word] + at - start

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"{k}{i}": getattr(b, k) for i, b in enumerate([*self.levels, self.sampled]) for k in ("words", "before")}
        np.savez(out, first=self.first, places=self.places, zeros=[b.zeros for b in [*self.levels, self.sampled]], **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> FMIndex:
        found = np.load(io.BytesIO(data))
        bits = [_Bits(found[f"words{i}"], found[f"before{i}"], int(z)) for i, z in enumerate(found["zeros"])]
        return cls(bits[:-1], found["first"], bits[-1], found["places"])
