"""Per-key state machines on streams, with transformWithStateInPandas and the RocksDB state store.

State is one small row per key (a last time, a last number, a book's levels); a key's rows of a
micro-batch are put in order before they are taken.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.dedupe import ledger_rows
from ..operators.sequences import BOOK_STATE, Book, apply_frame, book_rows
from ..session import put_on_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame | None:
    parts = list(rows)
    return pd.concat(parts).sort_values(by) if parts else None


class Cooldown(StatefulProcessor):
    """Lets a row through if it comes ``wait`` microseconds or more after the last one let through."""

    def __init__(self, wait: int, columns: list[str]):
        self.wait, self.columns = wait, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        batch, out = _in_order(rows, ["t", "id"]), []
        last = self.last.get()[0] if self.last.exists() else None
        for r in batch.itertuples(index=False):
            if last is None or r.t - last >= self.wait:
                last = r.t
                out.append(r)
        if out:
            self.last.update((int(last),))
            yield pd.DataFrame(out, columns=batch.columns)[self.columns]

    def close(self) -> None:
        pass


class SequenceAudit(StatefulProcessor):
    """Classifies each frame's number against the highest one of its space."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for r in _in_order(rows, ["turn"]).itertuples(index=False):
            seq = None if pd.isna(r.seq) else int(r.seq)
            verdict = "missing" if seq is None else "ok" if last is None else "duplicate" if seq == last else "regression" if seq < last else "gap" if seq > last + 1 else "ok"
            out.append((int(r.space), int(r.turn), last, verdict))
            last = seq if last is None or (seq is not None and seq > last) else last
        if last is not None:
            self.last.update((int(last),))
        yield pd.DataFrame(out, columns=["space", "turn", "last_seq", "verdict"]).astype({"last_seq": "Int64"})

    def close(self) -> None:
        pass


class BookKeeper(StatefulProcessor):
    """Keeps every market's book of a sequence space: the space's last number and faults in one value, a book's levels by market.

    Control frames use up numbers; a fault puts all books out until their own next snapshot, a new generation too.
    Only the books that a micro-batch touches are read and written.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.space = handle.getValueState("space", "generation long, seq long, faults long")
        self.books = handle.getMapState("books", "market long", "state string")

    def _load(self, market: int) -> Book:
        book = Book()
        if self.books.containsKey((market,)):
            x = json.loads(self.books.getValue((market,))[0])
            book.snapshot([(s, int(p), q) for s, levels in x["sides"].items() for p, q in levels.items()])
            book.epoch, book.fault = x["epoch"] and tuple(x["epoch"]), x["fault"]
        return book

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        generation, last, faults = self.space.get() if self.space.exists() else (None, None, 0)
        out, loaded = [], {}
        batch = _in_order(rows, ["turn"])
        for r in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
            of_book = r.kind in ("snapshot", "delta") and r.market is not None
            if not of_book and r.seq is None:
                continue
            if r.generation != generation:
                generation, last = r.generation, None
            verdict = "missing" if r.seq is None else "ok" if last is None or r.seq == last + 1 else "duplicate" if r.seq == last else "regression" if r.seq < last else "gap"
            faults += verdict in ("gap", "regression", "missing")
            last = r.seq if last is None or (r.seq is not None and r.seq > last) else last
            if not of_book or verdict == "duplicate":
                continue
            book = loaded.get(r.market) or loaded.setdefault(r.market, self._load(int(r.market)))
            apply_frame(book, r, (int(generation), int(faults)))
            out.append((r.space, r.market, r.generation, r.seq, *book.state()))
        for market, b in loaded.items():
            self.books.updateValue((int(market),), (json.dumps({"sides": b.sides, "epoch": b.epoch, "fault": b.fault}),))
        if generation is not None:
            self.space.update((int(generation), None if last is None else int(last), int(faults)))
        if out:
            yield book_rows(out)

    def close(self) -> None:
        pass


class Ledger(StatefulProcessor):
    """What is known of one key: whether it was seen, and with which content; forgotten ``retention`` microseconds after its last row.

    Rows wait until the watermark has passed their time and are then taken in order of (t, id), so micro-batches
    may bring them in any order within the lateness. A timer forgets the key, and a row without an id says so,
    so that what was evicted can be counted.
    """

    def __init__(self, retention: int):
        self.retention = retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, id long, content string")
        self.known = handle.getValueState("known", "t long, content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch.astype(object).where(batch.notna(), None)
            taken = [(int(t), int(i), c) for t, i, c in zip(batch["t"], batch["id"], batch["content"], strict=True)]
            self.waiting.appendList(taken)
            for at in {t // 1000 + 1 for t, _, _ in taken}:
                self.handle.registerTimer(at)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, (kind, name) = expiredTimerInfo.getExpiryTimeInMs() * 1000, key
        held = list(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = sorted((r for r in held if r[0] < due), key=lambda r: r[:2]), [r for r in held if r[0] >= due]
        known, out = (tuple(self.known.get()) if self.known.exists() else None), []
        evicted = lambda: out.append((kind, name, None, None, None, None, known[0] + self.retention))
        for t, i, content in ready:
            if known and t - known[0] >= self.retention:
                evicted()
                known = None
            out.append((kind, name, i, known is not None, known and known[1], content, t))
            known = (t, content)
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
            self.known.update(known)
            self.handle.registerTimer((known[0] + self.retention) // 1000 + 1)
        elif known and due > known[0] + self.retention:
            evicted()
            self.known.clear()
        if out:
            yield pd.DataFrame(out, columns=["kind", "key", "id", "seen", "was", "content", "t"]).astype({"id": "Int64", "seen": "boolean", "t": "Int64"})

    def close(self) -> None:
        pass


EVIDENCE = "kind string, key string, id long, seen boolean, was string, content string, t long"


def ledger_stream(artifacts: DataFrame, late: str, retention: int) -> DataFrame:
    """Evidence for ``dedupe.from_ledgers``: three rows per artifact, and one without an id per key forgotten.

    artifacts: id, t (microseconds), delivery, message, content. Each ledger's keys are dealt out by
    themselves, so no task holds a whole ledger. The three rows of an artifact come in one micro-batch, the one in which the
    watermark (``late`` behind the latest time) passes it; rows later than that are dropped, which Spark counts.
    """
    put_on_path(artifacts.sparkSession)
    timed = artifacts.withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", late)
    return ledger_rows(timed).groupBy("kind", "key").transformWithStateInPandas(Ledger(retention), EVIDENCE, "Append", "EventTime")


def cooldown_stream(rows: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """rows: the keys, t (microseconds), id; the rows that pass."""
    put_on_path(rows.sparkSession)
    return rows.groupBy(*keys).transformWithStateInPandas(Cooldown(int(seconds * 1_000_000), rows.columns), rows.schema, "Append", "None")


def sequence_stream(frames: DataFrame) -> DataFrame:
    """frames: space, turn (order of arrival), seq."""
    put_on_path(frames.sparkSession)
    return frames.groupBy("space").transformWithStateInPandas(SequenceAudit(), "space long, turn long, last_seq long, verdict string", "Append", "None")


def book_stream(frames: DataFrame) -> DataFrame:
    """frames as ``sequences.replay_books`` takes them, in ascending generations, with the same states."""
    put_on_path(frames.sparkSession)
    return frames.groupBy("space").transformWithStateInPandas(BookKeeper(), BOOK_STATE, "Append", "None")
