"""Recursive graph bisection: an order of documents in which those that share terms lie close together."""

from __future__ import annotations

import numpy as np

#: Rounds of swaps per level.
ROUNDS = 6


def _costs(n: int) -> np.ndarray:
    """c * log2(n / (c + 1)) of each count c, but for the constant: bits that c documents of a half take in the posting lists."""
    c = np.arange(n + 2, dtype=np.float64)
    return -c * np.log2(c + 1)


def bisected(doc: np.ndarray, term: np.ndarray, n_docs: int, leaf: int, rounds: int = ROUNDS) -> np.ndarray:
    """The documents 0 to ``n_docs`` - 1 in the new order, given postings (doc, term) that are distinct and sorted by doc.

    All parts of a level are halved at once. In a round, each document's gain is how much smaller the
    posting lists of its part become when it moves to the other half; the documents of the two halves are paired,
    largest gains first, and pairs with a gain are swapped. Parts of at most ``leaf`` documents stay.
    """
    order, bounds = np.arange(n_docs), np.array([0, n_docs])
    of_term = np.bincount(term)
    several = of_term[term] > 1  # a term of one document pulls nowhere
    doc, term = doc[several], term[several]
    cost = _costs(n_docs)
    while (np.diff(bounds) > leaf).any():
        sizes = np.diff(bounds)
        part_at = np.repeat(np.arange(len(sizes)), sizes)  # of each place in the order
        middle = bounds[:-1] + (sizes + 1) // 2
        middle = np.where(sizes > leaf, middle, bounds[1:])
        part = np.empty(n_docs, np.int64)
        part[order] = part_at
        right = np.empty(n_docs, bool)
        right[order] = np.arange(n_docs) >= middle[part_at]
        cells, cell = np.unique(part[doc] * len(of_term) + term, return_inverse=True)
        shared = np.bincount(cell)[cell] > 1
        d, cell = doc[shared], cell[shared]
        for _ in range(rounds):
            in_right = np.bincount(cell[right[d]], minlength=len(cells))
            in_left = np.bincount(cell[~right[d]], minlength=len(cells))
            now = cost[in_left] + cost[in_right]
            to_right = now - cost[np.maximum(in_left - 1, 0)] - cost[in_right + 1]
            to_left = now - cost[in_left + 1] - cost[np.maximum(in_right - 1, 0)]
            # a cost is a number of bits, less a constant of the halves; a move that lowers it is a gain
            gain = np.bincount(d, np.where(right[d], to_left[cell], to_right[cell]), minlength=n_docs)
            rank = np.lexsort((-gain, right, part))  # by part, left half first, largest gains first
            left_n = middle - bounds[:-1]
            pairs = np.minimum(left_n, sizes - left_n)
            which = np.repeat(np.arange(len(sizes)), pairs)
            k = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            a, b = rank[bounds[which] + k], rank[middle[which] + k]
            swap = gain[a] + gain[b] > 1e-9
            if not swap.any():
                break
            right[a[swap]], right[b[swap]] = True, False
        order = np.lexsort((np.arange(n_docs), right, part))
        bounds = np.unique(np.concatenate([bounds, middle]))
    return order
