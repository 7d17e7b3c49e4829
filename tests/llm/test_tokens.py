"""Packing, byte-level BPE, token files and token counts against plain encodings."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyarrow import fs as pafs
from tokenizers import Tokenizer

from tidemark.llm import bpe, chunks, packing, token_counts, token_files, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, np.uint32)


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


SPACES = [" ", "  ", "\n", " \n", "\n ", "\t", " ", "  ", "   ", "\r\n", "\x1c", "\x85", "​"]
PARTS = ["a", "don't", "I'll", "'s", "12", "é", "日本", "🙂", "foo.bar", "!!", "<|endoftext|>", "--"]


def random_text(rng):
    return "".join(rng.choice(SPACES if rng.random() < 0.45 else PARTS) for _ in range(rng.randrange(0, 30)))


def test_chunks_join_to_the_text():
    rng = random.Random(5)
    for _ in range(2000):
        text = random_text(rng)
        joined = chunks.joined(text.split(" "))
        assert joined[0] + "".join(" " + c for c in joined[1:]) == text


def test_memoised_encoding_is_exact(plain, tik):
    rng = random.Random(7)
    texts = [random_text(rng) for _ in range(3000)]
    memo_ids = tokens.encode_ids(PATH, texts)
    coder = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    for text, data, ids, spans in zip(texts, memo_ids, coder.encode(texts), tokens.encode_spans(PATH, texts), strict=True):
        assert np.array_equal(data, plain(text)), repr(text)
        assert ids.tolist() == tik.encode_ordinary(text), repr(text)
        assert coder.decode(ids) == text.encode()
        assert len(spans) == len(plain(text))


def test_spans_are_those_of_whole_texts():
    t, rng = Tokenizer.from_file(PATH), random.Random(9)
    texts = [random_text(rng).replace("<|endoftext|>", "x") for _ in range(500)]
    for text, spans in zip(texts, tokens.encode_spans(PATH, texts), strict=True):
        assert [tuple(x) for x in spans.tolist()] == t.encode(text, add_special_tokens=False).offsets, repr(text)


def test_small_memo(plain, monkeypatch):
    monkeypatch.setattr(chunks, "CACHE_CHUNKS", 3)

    def each(texts):
        found = [plain(x) for x in texts]
        return np.concatenate(found), np.array(list(map(len, found)))

    memo = chunks.ChunkMemo(each)
    for text in ("a b c d e f g", "a b " + "y" * 100 + " c", "a  b", "", " ", "a b c d"):
        assert memo.encode([text, text])[0].tolist() == plain(text).tolist() * 2


def test_long_pre_tokens(tik):
    rng, coder = random.Random(3), bpe.encoder(RANKS, public_tokenizers.PATTERN)
    for n in (1, 2, 50, 1000, 30_000):
        for letters in ("a", "ab", "thein", "éà日"):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert coder.encode([text])[0].tolist() == tik.encode_ordinary(text)


def test_long_pre_token_in_bounded_memory():
    import tracemalloc

    rng, coder = random.Random(5), bpe.encoder(RANKS, public_tokenizers.PATTERN)
    text = "".join(rng.choices("theinaxqou", k=10_000_000)).encode()
    tracemalloc.start()
    ids, counts = coder.merge([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.tolist() == [len(ids)]
    assert coder.decode(ids) == text
    assert peak < 10**9


def test_rank_queue():
    rng, queue, want = random.Random(1), bpe.RankQueue(50_256), defaultdict(set)
    for _ in range(3000):
        if want and rng.random() < 0.4:
            rank = min(want)
            got = queue.pop()
            assert (got[0], got[1].tolist()) == (rank, sorted(want.pop(rank)))
        else:
            rank, position = rng.randrange(50_256) if rng.random() < 0.5 else rng.randrange(5), rng.randrange(100)
            queue.push(rank, np.array([position]))
            want[rank].add(position)
    while want:
        rank = min(want)
        got = queue.pop()
        assert (got[0], got[1].tolist()) == (rank, sorted(want.pop(rank)))
    assert queue.pop() is None


@pytest.mark.parametrize("few", [0, bpe.FEW, 10**9])
def test_merge_of_ranks_that_fall(few, monkeypatch):
    """Ranks of a made-up vocabulary, where a merge may open a pair of lower rank than its own; against the plain rule."""
    monkeypatch.setattr(bpe, "FEW", few)
    rng = random.Random(11)
    ranks = {bytes([b]): b for b in range(256)}
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(150)}
    ranks |= {w: 256 + i for i, w in enumerate(rng.sample(sorted(words), len(words)))}
    coder = bpe.BytePairEncoder(ranks, r"\S+|\s+")

    def plain(piece):
        parts = [bytes([b]) for b in piece]
        while piece not in ranks:
            found = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
            if found is None:
                return [ranks[p] for p in parts]
            parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
            if len(parts) == 1:
                break
        return [ranks[piece]]

    texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 40))) for _ in range(800)]
    assert [x.tolist() for x in coder.encode(texts)] == [plain(t.encode()) for t in texts]


def test_bpe_round_trip_rows(odd, odd_rows, tik, empty):
    rows = bpe.round_trip(odd).collect()
    assert len(rows) == len(odd_rows)
    want = sorted((d is None, d or 0, len(tik.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, tik.encode_ordinary(t or ""))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in odd_rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want
    decoded = {(r["doc_id"], bytes(r["content"]).decode()) for r in bpe.decode_documents(bpe.encode_documents(odd)).collect()}
    assert decoded == {(d, t or "") for d, t in odd_rows}
    assert bpe.round_trip(empty).count() == 0


def brute_first_fit(lengths, capacity):
    bins, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for b, free in enumerate(bins):
            if free >= lengths[i]:
                break
        else:
            b = len(bins)
            bins.append(capacity)
        out[i] = (b, capacity - bins[b])
        bins[b] -= lengths[i]
    return [out[i] for i in range(len(lengths))]


def test_tournament_tree_is_first_fit_decreasing():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 17, 200):
        lengths = [rng.randrange(1, 65) for _ in range(n)]
        bins, offsets = packing.first_fit_decreasing(np.array(lengths, np.int64), 64)
        assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == brute_first_fit(lengths, 64)


def test_packing(odd, odd_rows, plain, empty):
    rows = packing.pack(odd, group_documents=20, keep_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        assert len(r["ids"]) == 4 * r["length"]
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
    want = defaultdict(int)
    for d, t in odd_rows:
        want[d, len(plain(t)) + 1] += len(plain(t)) + 1
    assert {k: sum(r["length"] for r in v) for k, v in pieces.items()} == want
    for d, t in odd_rows:
        ids = np.append(plain(t), np.uint32(0))
        for r in pieces[d, len(ids)]:
            if (d, len(ids)) in {(7, len(ids)), (8, len(ids))}:
                assert ids[r["start"] : r["start"] + r["length"]].tobytes() == r["ids"]
    for v in sequences.values():
        v.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in v] == [sum(x["length"] for x in v[:i]) for i in range(len(v))]
        assert sum(r["length"] for r in v) <= packing.SEQUENCE_TOKENS
    assert packing.pack(empty).count() == 0


def test_token_files(spark, odd, odd_rows, plain, empty, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    manifest = token_files.write_token_files(odd, folder)
    rows = token_files.read_token_files(manifest, folder, with_ids=True).orderBy("start").collect()
    assert len(rows) == len(odd_rows)
    start = 0
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    for r, (d, t) in zip(rows, order, strict=True):
        ids = np.append(plain(t), np.uint32(0)).tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (d, start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    some = token_files.read_token_files(manifest, folder, doc_ids=[7, 61], with_ids=True).collect()
    assert {r["doc_id"]: r["start"] for r in some} == {r["doc_id"]: r["start"] for r in rows if r["doc_id"] in (7, 61)}
    none = f"file://{tmp_path}/none"
    assert token_files.read_token_files(token_files.write_token_files(empty, none), none).count() == 0


def test_token_file_frames(tmp_path):
    import zstandard

    store, path = pafs.LocalFileSystem(), str(tmp_path / "x.zst")
    rng = np.random.default_rng(1)
    docs = [(i, rng.integers(0, 50_000, n, dtype=np.uint32).tobytes()) for i, n in enumerate([1, 5, token_files.FRAME_IDS + 3, 2])]
    with store.open_output_stream(path, compression=None) as sink:
        out = token_files.FrameWriter(sink)
        for d, data in docs:
            out.add(d, data)
        out.close()
    assert out.size == (tmp_path / "x.zst").stat().st_size
    with store.open_input_file(path) as source:
        reader = token_files.FrameReader(source)
        assert [d for d, _ in reader] == [0, 1, 2, 3]
        assert len(reader.entries) == 5
        assert {d: b"".join(reader.frame(k) for k in ks) for d, ks in reader} == dict(docs)
    whole = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert whole == b"".join(data for _, data in docs)  # plain readers skip the tables
    raw = bytearray((tmp_path / "x.zst").read_bytes())
    raw[12] ^= 255
    (tmp_path / "y.zst").write_bytes(raw)
    with store.open_input_file(str(tmp_path / "y.zst")) as source, pytest.raises((ValueError, zstandard.ZstdError)):
        bad = token_files.FrameReader(source)
        [bad.frame(k) for k in range(5)]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_owner_sections(rule):
    starts, spans = np.array([0, 5, 6, 20]), np.array([[0, 5], [3, 8], [4, 6], [5, 5], [2, 21], [19, 21]])
    owner, crossing = token_counts.owner_sections(spans, starts, rule)
    assert crossing.tolist() == [False, True, True, False, True, True]
    assert owner.tolist() == {"first": [0, 0, 0, 1, 0, 2], "last": [0, 2, 1, 1, 3, 3], "largest": [0, 0, 0, 1, 2, 2]}[rule]


def test_token_counts(odd, odd_rows, plain, empty):
    rows = token_counts.attribute_tokens(odd).collect()
    got, want = defaultdict(int), defaultdict(int)
    for r in rows:
        got[r["doc_id"]] += r["n_tokens"]
    for d, t in odd_rows:
        want[d] += len(plain(t))
    assert got == want
    lines = {(r["section"], r["section_start"], r["section_end"]) for r in rows if r["doc_id"] == 11}
    text = dict(odd_rows)[11]
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"]
    assert lines == {(k, s, e) for k, (s, e) in enumerate(zip([0, *ends[:-1]], ends, strict=True))}
    assert token_counts.attribute_tokens(empty).count() == 0
    with pytest.raises(ValueError):
        token_counts.attribute_tokens(odd, rule="no")


def test_token_counts_per_section(odd, odd_rows):
    coder, want = Tokenizer.from_file(PATH), defaultdict(int)
    for k, (d, t) in enumerate(odd_rows):
        t = t or ""
        starts = [0, *(i + 1 for i, c in enumerate(t) if c == "\n" and i + 1 < len(t))]
        ends, tokens = [*starts[1:], len(t)], [0] * len(starts)
        for s, e in coder.encode(t, add_special_tokens=False).offsets:
            held = [max(0, min(e, b) - max(s, a)) for a, b in zip(starts, ends, strict=True)]
            if max(held) == 0:  # a token without characters: where it stands
                held = [int(a <= s < b) for a, b in zip(starts, ends, strict=True)]
            tokens[held.index(max(held))] += 1
        for i, (a, b, n) in enumerate(zip(starts, ends, tokens, strict=True)):
            want[d, i, a, b, n] += 1
    got = defaultdict(int)
    for r in token_counts.attribute_tokens(odd).collect():
        got[r["doc_id"], r["section"], r["section_start"], r["section_end"], r["n_tokens"]] += 1
    assert got == want
