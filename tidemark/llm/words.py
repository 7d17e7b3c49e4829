"""Words of whole texts as bytes: one table maps ASCII letters to lower case and what is in no word to a space."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

from .common import BLOCK_BYTES


def _table(digits: bool) -> bytes:
    kept = lambda b: b >= 0x80 or chr(b).isalpha() or (digits and chr(b).isdigit())
    return bytes(ord(chr(b).lower()) if b < 0x80 and kept(b) else b if kept(b) else 0x20 for b in range(256))


#: Words of ASCII letters and code points from 0x80 on; and those with ASCII digits too. UTF-8 writes the latter in bytes from 0x80 on.
LETTERS, LETTERS_AND_DIGITS = _table(False), _table(True)


def byte_blocks(batches: Iterator[pa.RecordBatch], text_at: int, size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches holding about ``size`` bytes of text each, with their texts in UTF-8 (null: empty); a longer text is a block of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            total += n
            if total >= size or i + 1 == len(sizes):
                part = batch.slice(start, i + 1 - start)
                yield part, [t if t is not None else b"" for t in part.column(text_at).cast(pa.binary()).to_pylist()]
                start, total = i + 1, 0


def words(text: bytes, table: bytes, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists that cover about ``size`` bytes each, so that a long text is never one list."""
    plain, at = text.translate(table), 0
    while len(plain) - at > size:
        end = plain.find(b" ", at + size)
        if end < 0:
            break
        yield plain[at:end].split()
        at = end
    yield plain[at:].split()


def strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())
