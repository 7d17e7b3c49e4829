"""Token ids by the tokenizers library; one encoder and one memo per Python worker."""

from __future__ import annotations

import os
from functools import lru_cache, partial
from itertools import chain, pairwise

import numpy as np

from .chunks import ChunkMemo, Encoded
from .common import kept_for

#: The work whose tasks find the memos again.
WORK = "tokens"
#: The id that ends each document in packed and written form.
END_ID = 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> np.ndarray:
    """The bytes of each id's token; a byte-level vocabulary writes each byte as one character."""
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
    for token, i in vocabulary.items():
        out[i] = len(token)
    return out


def _encode_each(path: str, texts: list[str]) -> Encoded:
    found = [e.ids for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
    return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))


def _encode_joined(path: str, chunks: list[str]) -> Encoded:
    """The ids of chunks that make one text; they are cut apart by the bytes of the tokens.

    Where a chunk doesn't end with a token (the vocabulary isn't byte-level), each is encoded alone.
    """
    text = "".join(chunks)
    ids = np.array(tokenizer(path).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
    token_ends = np.cumsum(_token_bytes(path)[ids])
    ends = np.cumsum(np.fromiter(map(len, chunks) if text.isascii() else (len(c.encode()) for c in chunks), np.int64, len(chunks)))
    at = np.searchsorted(token_ends, ends)
    if not len(ids) or at[-1] + 1 != len(ids) or (token_ends[at] != ends).any():
        return _encode_each(path, chunks)
    return ids, np.diff(at, prepend=-1)


def _spans_each(path: str, texts: list[str]) -> Encoded:
    found = [e.offsets for e in tokenizer(path).encode_batch(texts, add_special_tokens=False)]
    return np.array([x for offsets in found for x in offsets], np.int32).reshape(-1, 2), np.fromiter(map(len, found), np.int64, len(found))


@lru_cache(maxsize=2)
def _ids_memo(path: str) -> ChunkMemo:
    return ChunkMemo(partial(_encode_each, path), partial(_encode_joined, path))


@lru_cache(maxsize=2)
def _spans_memo(path: str) -> ChunkMemo:
    return ChunkMemo(partial(_spans_each, path), kind=np.int32, width=2)


kept_for(WORK, _ids_memo.cache_clear)
kept_for(WORK, _spans_memo.cache_clear)


def encode_ids(path: str, texts: list[str]) -> list[np.ndarray]:
    """Each text's ids as unsigned 32-bit integers, without special tokens added."""
    ids, counts = _ids_memo(path).encode(texts)
    return np.split(ids, np.cumsum(counts)[:-1])


def ended_ids(path: str, texts: list[str]) -> list[bytes]:
    """Each text's ids and END_ID, as little-endian unsigned 32-bit integers."""
    ids, counts = _ids_memo(path).encode(texts)
    data = np.insert(ids, np.cumsum(counts), END_ID).astype("<u4", copy=False).tobytes()
    ends = (4 * np.cumsum(counts + 1)).tolist()
    return [data[s:e] for s, e in pairwise([0, *ends])]


def encode_spans(path: str, texts: list[str]) -> list[np.ndarray]:
    """Each text's token spans, an (n, 2) array of character offsets."""
    memo = _spans_memo(path)
    split, numbers, counts = memo.numbers(texts)
    spans, lengths = memo.runs.take(numbers)
    chars = np.fromiter(map(len, chain.from_iterable(split)), np.int64, len(numbers)) + 1
    ends = np.cumsum(counts)
    firsts = ends - counts
    chars[firsts] -= 1
    starts = np.cumsum(chars) - chars  # of a chunk with its leading space, in the block
    starts -= np.repeat(starts[firsts], counts)
    spans = spans.astype(np.int64) + np.repeat(starts, lengths)[:, None]
    tokens = np.cumsum(lengths)
    return np.split(spans, tokens[ends - 1][:-1])
