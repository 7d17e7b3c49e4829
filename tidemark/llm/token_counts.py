"""Token counts by section: offset-mapped attribution of whole-document encodings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import put_on_path, text_blocks
from .tokens import WORK, default_tokenizer, encode_spans

RULES = ("first", "last", "largest")
_COLUMNS = ["doc_id", "section", "section_start", "section_end", "n_tokens", "n_crossing"]


def line_starts(text: str) -> np.ndarray:
    """Where lines start; a line holds its line end. An empty text is one empty line; there is no line after the last line end."""
    starts, at = [0], text.find("\n")
    while at != -1 and at + 1 < len(text):
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(starts, np.int64)


def owner_sections(spans: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of token spans to sections that follow each other: the section that owns each token, and whether it crosses.

    'first' and 'last' give a crossing token to the section of its first or last character; 'largest'
    to the section that holds most of its characters, the earlier one among equals.
    """
    first = np.searchsorted(starts, spans[:, 0], "right") - 1
    last = np.maximum(first, np.searchsorted(starts, np.maximum(spans[:, 1] - 1, spans[:, 0]), "right") - 1)
    crossing = first != last
    owner = last.copy() if rule == "last" else first.copy()
    if rule == "largest":
        for k in np.flatnonzero(crossing):
            edges = np.concatenate([[spans[k, 0]], starts[first[k] + 1 : last[k] + 1], [spans[k, 1]]])
            owner[k] = first[k] + int(np.argmax(np.diff(edges)))
    return owner, crossing


def attribute_tokens(docs: DataFrame, rule: str = "largest", sections: Callable[[str], np.ndarray] = line_starts, tokenizer_path: str | None = None) -> DataFrame:
    """Tokens per section of every row of ``docs`` (doc_id, text), each document encoded once and whole.

    ``sections`` gives the ascending starts of a text's sections, 0 first; a section ends where the
    next starts. One row per section: doc_id, section (from 0), section_start, section_end
    (characters), n_tokens (tokens it owns by ``rule``), n_crossing (of those, tokens that reach into
    another section). A document's n_tokens add up to its token count. A null or empty text is
    one section without tokens; a null doc_id stays null; repeated rows are counted each; an empty table
    gives no rows; further columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule: one of {RULES}")
    put_on_path(docs.sparkSession)
    path = tokenizer_path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_blocks(batches, 1, work=WORK):
            ids, numbers, starts_all, ends_all, tokens, crossings = [], [], [], [], [], []
            for doc_id, text, spans in zip(rows.column(0).to_pylist(), texts, encode_spans(path, texts), strict=True):
                starts = sections(text)
                owner, crossing = owner_sections(spans, starts, rule)
                n = len(starts)
                ids += [doc_id] * n
                numbers.append(np.arange(n))
                starts_all.append(starts)
                ends_all.append(np.append(starts[1:], len(text)))
                tokens.append(np.bincount(owner, minlength=n))
                crossings.append(np.bincount(owner[crossing], minlength=n))
            arrays = [pa.array(ids, pa.int64()), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (numbers, starts_all, ends_all, tokens, crossings))]
            yield pa.RecordBatch.from_arrays(arrays, _COLUMNS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{c} long" for c in _COLUMNS))
