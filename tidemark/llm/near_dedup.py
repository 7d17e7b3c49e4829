"""MinHash near-dedup with odd sketches.

Documents with equal shingle sets become one class first. Classes meet in LSH buckets; an odd
sketch (MinHash samples folded into a parity bitmap) estimates a pair's similarity from the
population count of the XOR. Pairs that may reach the threshold make families, and within a family each such
pair is confirmed on full sets.

Both steps look for components, not for all pairs: a task that compares a block keeps the components it has
found so far, passes over pairs that are already in one, and returns only links that join two. So what
leaves a task grows with its rows, whatever the size of a group of copies; and every pair that shares a
bucket is in one component or compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_for, put_on_path, text_blocks, turn_to, written
from .components import connected_components

#: A pair at 0.8 shares one of 40 bands of 7 samples with a chance of 0.9999, at 0.85 of 0.9999998.
BANDS, ROWS = 40, 7
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
SHINGLE_WORDS = 5
#: Members of a block in which sketches are compared, and shingles of a block in which full sets are, on average.
BLOCK, BLOCK_ITEMS = 4096, 1 << 20
#: Rows whose full sets are compared with one row's at once.
AT_ONCE = 256
#: Class ids (8 bytes each) up to which a side is broadcast; beyond it the texts are shuffled to them.
BROADCAST_IDS = 500_000

_SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>"


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 500_000:
            self.clear()
        self[word] = value
        return value


_words = _WordHashes()
kept_for("shingles", _words.clear)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=8)
def _odd_numbers(n: int, seed: int, kind: str) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, np.iinfo(kind).max, n, dtype=kind, endpoint=True) | np.array(1, kind)


def shingles(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; A-Z lower-cased, words by white space bytes."""
    split = text.encode().lower().split()  # of bytes: only ASCII letters and 0x20, 0x09 to 0x0D
    n = len(split)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, split), np.uint64, n)
    size = min(n, words)
    factors = _odd_numbers(words + 1, 5, "uint64")
    total = np.full(n - size + 1, (factors[words:] * np.uint64(size))[0], np.uint64)
    for i in range(size):
        total += hashes[i : n - size + 1 + i] * factors[i]
    return np.unique(_mix(total))


def minhash(values: np.ndarray) -> np.ndarray:
    """SAMPLES smallest values under as many hash functions of the two halves of each shingle hash."""
    low, high = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    a, b = _odd_numbers(SAMPLES, 1, "uint32")[:, None], _odd_numbers(SAMPLES, 2, "uint32")[:, None]
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(values), 1024):
        v = a * low[at : at + 1024] + b * high[at : at + 1024]
        v ^= v >> np.uint32(15)
        np.minimum(out, v.min(axis=1), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    parts = samples.reshape(BANDS, ROWS).astype(np.uint64) * _odd_numbers(ROWS, 3, "uint64")
    return _mix(_mix(parts.sum(axis=1, dtype=np.uint64)) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity of the number of (sample number, sample) items that hash to each bit."""
    bits = _mix(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    parity = (np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.int64)


def xor_count(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ between sketches; numpy counts the bits of absolute values, so as unsigned numbers."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1)


def sketch_distance_limit(threshold: float, deviations: float = 5.0) -> int:
    """The largest XOR population count of a pair that is still confirmed on full sets.

    A pair at the threshold has on average d = 2k(1-J) differing items, which leave m/2 * (1 - exp(-2d/m))
    odd bits. Their deviation comes from the k samples and from the folding into m bits; five of
    both together are added, so that fewer than one in a million pairs at the threshold lie beyond.
    """
    m, d = SKETCH_BITS, 2 * SAMPLES * (1 - threshold)
    ones = m / 2 * (1 - math.exp(-2 * d / m))
    of_samples = 2 * SAMPLES * math.sqrt(threshold * (1 - threshold) / SAMPLES) * math.exp(-2 * d / m)
    of_folding = m / 4 * (1 - math.exp(-4 * d / m)) - d * math.exp(-4 * d / m)
    return math.ceil(ones + deviations * math.sqrt(of_samples**2 + of_folding))


def estimated_similarity(distance: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that an XOR population count stands for."""
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(np.maximum(1e-9, 1 - 2 * np.asarray(distance) / SKETCH_BITS))


def sign(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_blocks(batches, 1, work="shingles"):
            n, keys, bands, sketches = [], [], [], []
            for text in texts:
                values = shingles(text)
                n.append(len(values))
                keys.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
                samples = minhash(values) if len(values) else None
                bands.append(None if samples is None else band_keys(samples))
                sketches.append(None if samples is None else odd_sketch(samples))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, longs), pa.array(sketches, longs)], ["doc_id", "n_shingles", "set_key", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SIGNED)


def _distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)


def _passing(pairs: DataFrame, classes: DataFrame, percent: int, limit: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches let them reach the threshold."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .where(_distance("sketch_a", "sketch_b") <= limit)
        .select("a", "b")
    )


def _sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, set_key, items) of the classes (cid, set_key); items are a set's 64-bit hashes as bytes."""
    ids = classes.select("cid").distinct()
    n = classes.count()
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("cid"), "text").join(ids, "cid", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in text_blocks(batches, 1, work="shingles"):
            found = {}
            for cid, text in zip(rows.column(0).to_pylist(), block, strict=True):
                values = shingles(text).tobytes()
                found[cid, hashlib.blake2b(values, digest_size=16).digest()] = values
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*zip(*found, strict=True), list(found.values())), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["cid", "set_key", "items"])

    return texts.mapInArrow(run, "cid long, set_key binary, items binary")


class _Items:
    """The full sets of a group's rows, as numbers within the group, for counts of shared items."""

    def __init__(self, sets: list[bytes]):
        arrays = [np.frombuffer(x, np.uint64) for x in sets]
        self.ends = np.cumsum([len(x) for x in arrays])
        self.sizes = np.diff(self.ends, prepend=0)
        distinct, self.flat = np.unique(np.concatenate(arrays), return_inverse=True)
        self.flat, self.marks = self.flat.astype(np.int32), np.zeros(len(distinct), np.int32)

    def of(self, k: int) -> np.ndarray:
        return self.flat[self.ends[k] - self.sizes[k] : self.ends[k]]

    def shared(self, k: int, others: np.ndarray) -> np.ndarray:
        """How many items row k has in common with each of ``others``; no set is empty."""
        self.marks[self.of(k)] = 1
        sizes = self.sizes[others]
        out = np.add.reduceat(self.marks[np.concatenate([self.of(i) for i in others.tolist()])], np.cumsum(sizes) - sizes)
        self.marks[self.of(k)] = 0
        return out


def _spanning_links(group: dict[str, np.ndarray], limit: int, percent: int, items: _Items | None, across: bool) -> list[tuple[int, int]]:
    """Links that join the same rows as all links between an outside row and a row of the group's block do; ``across``: of rows of one block none count.

    A pair is compared on sizes and sketches; where there are full sets, it is a link only if these
    confirm it. Pairs that earlier links have already put in one component are passed over. Two outside rows of
    different blocks meet in both; they are compared in the block of the larger id.
    """
    ids, component, outside, block, n, sketch = (group[c] for c in ("cid", "component", "outside", "block", "n", "sketch"))
    component, found, place = component.copy(), [], np.arange(len(ids))
    own = block == group["low"][0]
    for k in np.flatnonzero(outside).tolist():
        near = own & (component != component[k]) & (~outside | (place > k)) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k]))
        if across:
            near &= block != block[k]
        at = np.flatnonzero(near)
        at = at[xor_count(sketch[at], sketch[k]) <= limit] if len(at) else at
        while len(at):
            links, at = at[:AT_ONCE], at[AT_ONCE:]
            if items is not None:
                shared = items.shared(k, links)
                links = links[100 * shared >= percent * (items.sizes[k] + items.sizes[links] - shared)]
            if len(links):
                joined, first = np.unique(component[links], return_index=True)
                found += [(min(int(ids[k]), other), max(int(ids[k]), other)) for other in ids[links[first]].tolist()]
                component[np.isin(component, joined)] = component[k]
                at = at[component[at] != component[k]]
        if found and (component == component[k]).all():
            break
    return found


_GROUP = "key long, low int, cid long, component long, outside boolean, block int, n long, sketch array<long>"


def _linked(dealt: DataFrame, limit: int, percent: int, exact: bool, across: bool = False) -> DataFrame:
    """Spanning links (a, b) within the groups (key, low) of ``dealt``; a task streams through its groups, and only such links leave it."""
    rows = dealt.repartition("key", "low").sortWithinPartitions("key", "low", "cid")

    def links(t: pa.Table, edges: list[int]) -> pa.RecordBatch:
        found = []
        for s, e in pairwise(edges):
            part = t.slice(s, e - s)
            group = {c: part.column(c).to_numpy() for c in ("low", "cid", "component", "outside", "block", "n")}
            if group["outside"].any() and (group["component"] != group["component"][0]).any():
                group["sketch"] = part.column("sketch").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1)
                found += _spanning_links(group, limit, percent, _Items(part.column("items").to_pylist()) if exact else None, across)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("links")
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(2)], axis=1)
            starts = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
            if last is not None and (keys[0] != last).any():
                starts = [0, *starts]
            if starts:  # the last group may go on in the next batch
                head = [*held, batch.slice(0, starts[-1])]
                before = sum(x.num_rows for x in held)
                yield links(pa.Table.from_batches(head), sorted({0, *(before + x for x in starts)}))
                held = [batch.slice(starts[-1])]
            else:
                held.append(batch)
            last = keys[-1]
        if held:
            yield links(pa.Table.from_batches(held), [0, sum(x.num_rows for x in held)])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _dealt(rows: DataFrame, weight: Column, block: int, own_block: bool = False) -> DataFrame:
    """``rows`` (key, cid, component, ...) of keys that hold more than one component, laid out by blocks.

    A key's rows are dealt to blocks of about ``block`` weight. Members outside its largest component are
    compared with all others, so they go to every block; the others, which may be most of the rows, to their
    own only. With ``own_block`` all are compared, but within their block: only the key's own row
    (cid = key) goes to every one, and is of that block there.
    """
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("rows"), F.sum(weight).alias("weight"))
    keys = parts.groupBy("key").agg(F.max_by("component", F.struct("rows", "component")).alias("head"), (F.sum("weight") / block).cast("int").alias("last"), F.count("*").alias("parts"))
    rows = rows.join(keys.where("parts > 1").drop("parts"), "key").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("last") + 1).cast("int"))
    rows = rows.withColumn("outside", F.lit(True) if own_block else F.col("component") != F.col("head"))
    every = F.col("cid") == F.col("key") if own_block else F.col("outside")
    rows = rows.withColumn("low", F.explode(F.when(every, F.sequence(F.lit(0), F.col("last"))).otherwise(F.array("block"))))
    return (rows.withColumn("block", F.col("low")) if own_block else rows).drop("head")


def _families(members: DataFrame, classes: DataFrame, percent: int, limit: int) -> DataFrame:
    """(node, component) of classes that sketches join: components over pairs of one bucket whose sizes and sketches are near.

    A bucket's members are compared with its smallest and largest one; then, where that has not made
    one component of them, with one another in blocks.
    """
    star = members.select(F.col("cid").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).where("a <> b").distinct()
    star = written(_contracted(_passing(star, classes, percent, limit)), "near")
    components = connected_components(star).withColumnRenamed("node", "cid")
    named = members.select(F.col("band").alias("key"), "cid").join(components, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    dealt = _dealt(written(named, "buckets"), F.lit(1), BLOCK).join(classes.select("cid", F.col("n_shingles").alias("n"), "sketch"), "cid")
    return connected_components(star.union(_linked(dealt.select(_columns(_GROUP)), limit, percent, False)))


def _contracted(star: DataFrame) -> DataFrame:
    """Links (a, b) that join the same classes as ``star`` (a, hub b): each member with its smallest hub, and that one with the member's others.

    A member has two hubs a band at most; members of one family share them, so links between hubs are few.
    """
    by = star.groupBy("a").agg(F.min("b").alias("least"), F.collect_set("b").alias("hubs"))
    hubs = by.select(F.col("least").alias("a"), F.explode("hubs").alias("b")).where("a <> b").distinct()
    return by.select("a", F.col("least").alias("b")).union(hubs)


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _confirmed(docs: DataFrame, families: DataFrame, classes: DataFrame, percent: int, limit: int) -> DataFrame:
    """Links, confirmed on full sets, that join the same classes as all links within families do.

    Each family is compared block by block, each block with the family's first member as well; then what is still
    apart from the rest of its family is compared with the other blocks. A family of one block, the common case, is laid out once.
    """
    roster = written(classes.join(families.select(F.col("node").alias("cid"), F.col("component").alias("key")), "cid").select("key", "cid", "set_key", F.col("n_shingles").alias("n"), "sketch"), "families")
    sets = written(_sets(docs, roster), "sets")
    full = lambda dealt: dealt.join(sets, ["cid", "set_key"]).select([*_columns(_GROUP), "items"])
    own = _dealt(roster.withColumn("component", F.col("cid")), F.col("n"), BLOCK_ITEMS, own_block=True)
    links = written(_linked(full(own), limit, percent, True), "links")
    components = connected_components(links).withColumnRenamed("node", "cid")
    rest = _dealt(roster.join(components, "cid", "left").withColumn("component", F.coalesce("component", "cid")), F.col("n"), BLOCK_ITEMS).where("last > 0")
    return links.union(_linked(full(rest), limit, percent, True, across=True))


def near_dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Near-duplicate components of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept per row.

    Two documents are linked when 100 * |A & B| >= percent * |A | B| over their sets of distinct
    five-word shingles (a shorter text: the whole sequence as one). The component id is the
    smallest doc_id that links reach; that document is kept. Documents without words have
    the empty set, link with nothing and are kept. Rows without a doc_id get the component of documents
    with an equal set, if any, and are kept only if there is none. Rows that repeat a doc_id
    are taken as one document when links are followed. An empty table gives no rows; further columns
    are ignored.
    """
    put_on_path(docs.sparkSession)
    limit = sketch_distance_limit(percent / 100)
    signed = written(sign(docs), "signed")
    classes = (
        signed.where("set_key is not null and doc_id is not null").groupBy("set_key")
        .agg(F.min("doc_id").alias("cid"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    )
    classes = written(classes, "classes")
    banded = classes.select("cid", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi")
    members = written(banded.join(hubs, "band"), "members")
    families = _families(members, classes, percent, limit)
    components = connected_components(_confirmed(docs, families, classes, percent, limit))
    named = classes.select("set_key", "cid").join(components.withColumnRenamed("node", "cid"), "cid", "left").select("set_key", F.coalesce("component", "cid").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
