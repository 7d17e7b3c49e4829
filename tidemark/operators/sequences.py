"""Sequence audit, hash chains and order-book replay over ordered frames."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sequence_verdict(seq: Column, last: Column) -> Column:
    """ok, duplicate, gap, regression or missing, against the highest number seen before."""
    return F.when(seq.isNull(), "missing").when(last.isNull(), "ok").when(seq == last, "duplicate").when(seq < last, "regression").when(seq > last + 1, "gap").otherwise("ok")


def audit(frames: DataFrame, space: str, seq: str, order: list[str]) -> DataFrame:
    """Each frame's verdict and the last number before it, per sequence space, in order of arrival."""
    w = Window.partitionBy(space).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(seq).over(w)
    return frames.withColumn("last_seq", last).withColumn("verdict", sequence_verdict(F.col(seq), F.col("last_seq")))


def verify_chain(entries: DataFrame, keys: list[str], seq: str, prev: str, digest: str) -> DataFrame:
    """Per chain: entries, and the first whose link to the one before it is broken (null: the chain holds)."""
    w = Window.partitionBy(*keys).orderBy(seq)
    before = F.lag(digest).over(w)
    broken = F.when(before.isNull(), F.col(prev).isNotNull()).otherwise(~F.col(prev).eqNullSafe(before))
    return entries.withColumn("_broken", broken).groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.when(F.col("_broken"), F.col(seq))).alias("first_broken"))


class Book:
    """One market's two sides, as whole price levels; faults stop it until its next snapshot, a new epoch until its own.

    The best prices come from heaps whose gone levels are dropped when they reach the top, and the total runs
    along, so a frame costs what it changes and not the depth of the book.
    """

    def __init__(self):
        self.sides: dict[str, dict[int, int]] = {"yes": {}, "no": {}}
        self.heaps: dict[str, list[int]] = {"yes": [], "no": []}
        self.total, self.epoch, self.fault = 0, None, "awaiting_rebase"

    def begin(self, epoch: tuple[int, int]) -> None:
        """A new generation, or a fault of the sequence that all books of a space share: the book waits for its own snapshot."""
        if epoch != self.epoch:
            self.epoch, self.fault = epoch, "awaiting_rebase"

    def snapshot(self, levels: Iterable[tuple[str, int, int]]) -> None:
        """Replaces the book; a snapshot with a level twice, or with a missing or negative part, is refused whole and stops it."""
        sides: dict[str, dict[int, int]] = {"yes": {}, "no": {}}
        for side, price, size in levels:
            if side not in sides or price is None or size is None or size < 0 or price in sides[side]:
                self.fault = "snapshot_rejected"
                return
            sides[side][price] = size
        self.sides = {s: {p: q for p, q in x.items() if q} for s, x in sides.items()}
        self.heaps = {s: [-p for p in x] for s, x in self.sides.items()}
        for heap in self.heaps.values():
            heapify(heap)
        self.total, self.fault = sum(sum(x.values()) for x in self.sides.values()), None

    def delta(self, side: str | None, price: int | None, change: int | None) -> None:
        """Adds to a level; a level at zero goes; below zero, or without a part, the book halts and stays as it was."""
        if self.fault is not None:
            return
        if side not in self.sides or price is None or change is None:
            self.fault = "delta_rejected"
            return
        levels = self.sides[side]
        left = levels.get(price, 0) + change
        if left < 0:
            self.fault = "negative_level"
            return
        if price not in levels and left:
            heappush(self.heaps[side], -price)
        if left:
            levels[price] = left
        else:
            levels.pop(price, None)
        self.total += change

    def best(self, side: str) -> int | None:
        heap, levels = self.heaps[side], self.sides[side]
        while heap and -heap[0] not in levels:
            heappop(heap)
        return -heap[0] if heap else None

    def state(self) -> tuple[bool, str, int | None, int | None, int | None]:
        """Whether it can be published, why not, and, only if so, the best price of each side and the total size."""
        return (True, "ok", self.best("yes"), self.best("no"), self.total) if self.fault is None else (False, self.fault, None, None, None)


BOOK_STATE = "space long, market long, generation long, seq long, publishable boolean, reason string, best_yes long, best_no long, size long"
#: Verdicts on a number that put every book of a space out.
_LOST = ("gap", "regression", "missing")


def routed(frames: DataFrame) -> DataFrame:
    """Frames that reach a book, with ``faults``: how often their space's sequence had failed by then.

    All frames of a space share one sequence per generation, in order of ``turn``, and those that are of no book (control
    frames) use up numbers too; without a number they are passed over. A repeated number is a redelivery and
    ignored; a gap, a number that falls back, or none on a frame of a book, may have lost a frame of any book.
    """
    order = Window.partitionBy("space").orderBy("turn")
    of_book = F.col("kind").isin("snapshot", "delta") & F.col("market").isNotNull()
    seen = frames.where(of_book | F.col("seq").isNotNull())
    before = Window.partitionBy("space", "generation").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("_verdict", sequence_verdict(F.col("seq"), F.max("seq").over(before)))
    seen = seen.withColumn("faults", F.sum(F.col("_verdict").isin(*_LOST).cast("int")).over(order))
    return seen.where(of_book & (F.col("_verdict") != "duplicate")).drop("_verdict")


def replay_books(frames: DataFrame) -> DataFrame:
    """The state of each market's book after each of its frames.

    frames: space, turn (order of arrival, distinct in a space), market, generation, seq, kind ('snapshot', 'delta' or
    anything else for control frames), levels (of a snapshot: side, price, size), and side, price, change of a delta.
    Faults of a space's sequence are found by windows first; then markets, not spaces, are dealt out and each is
    folded in order as a stream, with one book at a time in memory. Repeated frames have one number and are
    ignored; frames without a space share one; an empty table gives no rows.
    """
    dealt = routed(frames).repartition("space", "market").sortWithinPartitions("space", "market", "turn")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, book = None, None
        for rows in batches:
            out = []
            for r in rows.astype(object).where(rows.notna(), None).itertuples(index=False):
                if (r.space, r.market) != at:
                    at, book = (r.space, r.market), Book()
                apply_frame(book, r, (r.generation, r.faults))
                out.append((r.space, r.market, r.generation, r.seq, *book.state()))
            yield book_rows(out)

    return dealt.select("space", "market", "generation", "seq", "faults", "kind", "levels", "side", "price", "change").mapInPandas(fold, BOOK_STATE)


def apply_frame(book: Book, frame: Any, epoch: tuple[int, int]) -> None:
    whole = lambda x: None if x is None else int(x)
    book.begin(epoch)
    if frame.kind == "snapshot":
        book.snapshot([(x["side"], whole(x["price"]), whole(x["size"])) for x in (frame.levels if frame.levels is not None else ())])
    else:
        book.delta(frame.side, whole(frame.price), whole(frame.change))


def book_rows(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in BOOK_STATE.split(", ")])
    return frame.astype({c: "Int64" for c in ("space", "market", "generation", "seq", "best_yes", "best_no", "size")})


def reconcile(ours: DataFrame, theirs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that differ between two accounts of the same keys: missing on a side or with another value."""
    both = ours.select(*keys, F.col(value).alias("ours")).join(theirs.select(*keys, F.col(value).alias("theirs")), keys, "full")
    kind = F.when(F.col("ours").isNull(), "only_theirs").when(F.col("theirs").isNull(), "only_ours").otherwise("differs")
    return both.where(~F.col("ours").eqNullSafe(F.col("theirs"))).withColumn("kind", kind)
