"""Order-binding digests: records chained within a segment, segments bound by a tree of digests.

Sealing a chain is sequential by its nature, so a segment's sorted records stream through one task. Checking
isn't: each record is held against the one before it by a join on (segment, ordinal), and the order of all
records is bound by a tree whose nodes are the digests of ``FANOUT`` children in order, so that a segment of any
length spreads over tasks and no task holds more than a node's children.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Children of a node, and levels: segments of up to FANOUT ** LEVELS records.
FANOUT, LEVELS = 1024, 3


def genesis(segment: Column) -> Column:
    """What the first record of a segment names as the one before it."""
    return F.sha2(F.concat(F.lit("genesis\n"), segment.cast("string")), 256)


def tagged(content: Column) -> Column:
    """Content in a form in which missing and empty differ."""
    return F.when(content.isNull(), "-").otherwise(F.concat(F.lit("+"), content))


def record_digest(segment: Column, ordinal: Column, prev: Column, content: Column) -> Column:
    """The digest of a record: of its segment, its place, the digest before it and its content."""
    return F.sha2(F.concat_ws("\n", segment.cast("string"), ordinal.cast("string"), prev, tagged(content)), 256)


def sealed(records: DataFrame) -> DataFrame:
    """``records`` (segment, ordinal, content, ...) with ``prev`` and ``digest``, chained in order of the ordinal.

    Records without a segment or an ordinal can't be sealed: a null ordinal is an error. Records that repeat an
    ordinal are chained one after the other; ``verified`` tells them. An empty table gives no rows.
    """
    base = records.withColumn("ordinal", F.when(F.col("ordinal").isNotNull() & F.col("segment").isNotNull(), F.col("ordinal")).otherwise(F.raise_error(F.lit("a record has no segment or ordinal")).cast("long")))
    base = base.withColumn("prev", genesis(F.col("segment"))).withColumn("digest", tagged(F.col("content")))

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, None
        for rows in batches:
            prev, digests = [], []
            for segment, ordinal, first, content in zip(rows["segment"], rows["ordinal"], rows["prev"], rows["digest"], strict=True):
                last = first if segment != at else last
                at = segment
                prev.append(last)
                last = hashlib.sha256(f"{segment}\n{ordinal}\n{last}\n{content}".encode()).hexdigest()
                digests.append(last)
            yield rows.assign(prev=prev, digest=digests)

    return base.repartition("segment").sortWithinPartitions("segment", "ordinal", "content").mapInPandas(chain, base.schema)


def roots(digests: DataFrame, keys: list[str], levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """(keys, root) of ``digests`` (keys, at, digest): the top of the tree over the digests in order of ``at``.

    Digests of one place stand by their value. Each level is one grouping by runs of places, pre-dealt by key and run.
    """
    nodes = digests.select(*keys, F.col("at").cast("long").alias("at"), "digest")
    for _ in range(levels):
        runs = nodes.groupBy(*keys, F.floor(F.col("at") / fanout).alias("run")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("children"))
        nodes = runs.select(*keys, F.col("run").alias("at"), F.sha2(F.array_join(F.transform("children", lambda x: x["digest"]), ":"), 256).alias("digest"))
    return nodes.select(*keys, F.col("digest").alias("root"))


def manifests(records: DataFrame) -> DataFrame:
    """Per segment of sealed records: records, first_digest, last_digest, root. Written when a segment closes; a check is held against it."""
    ends = records.groupBy("segment").agg(F.count("*").alias("records"), F.min_by("digest", "ordinal").alias("first_digest"), F.max_by("digest", "ordinal").alias("last_digest"))
    return ends.join(roots(records.select("segment", F.col("ordinal").alias("at"), "digest"), ["segment"]), "segment")


def faults(records: DataFrame) -> DataFrame:
    """Records with ``fault``: the first thing wrong with one by itself and against the record before it, or null.

    content_changed: its digest isn't that of what it holds; ordinal_repeated: another has its place;
    wrong_genesis: it is first and doesn't name its segment's genesis; predecessor_missing: nothing has the place
    before it; link_broken: it names another digest than the record before it has.
    """
    by = records.groupBy("segment", "ordinal").agg(F.count("*").alias("_same"), F.min("digest").alias("_digest"))
    before = by.select("segment", (F.col("ordinal") + 1).alias("ordinal"), F.col("_digest").alias("_before"))
    own = by.select("segment", "ordinal", "_same")
    joined = records.join(own, ["segment", "ordinal"]).join(before, ["segment", "ordinal"], "left")
    first = F.col("ordinal") == 0
    fault = (
        F.when(~F.col("digest").eqNullSafe(record_digest(F.col("segment"), F.col("ordinal"), F.col("prev"), F.col("content"))), "content_changed").when(F.col("_same") > 1, "ordinal_repeated")
        .when(first & ~F.col("prev").eqNullSafe(genesis(F.col("segment"))), "wrong_genesis").when(first, None)
        .when(F.col("_before").isNull(), "predecessor_missing").when(~F.col("prev").eqNullSafe(F.col("_before")), "link_broken")
    )
    return joined.withColumn("fault", fault).drop("_same", "_before")


def verified(records: DataFrame, committed: DataFrame) -> DataFrame:
    """Per segment: records, first_fault (its ordinal), and ``verdict`` against the committed manifests.

    A record's fault comes before what only the manifest can tell: segment_missing, segment_unknown,
    count_differs (a dropped tail), root_differs (a whole chain sealed anew). Records without a segment are one
    segment that is unknown. ok otherwise.
    """
    found = faults(records).groupBy("segment").agg(F.count("*").alias("records"), F.min(F.when(F.col("fault").isNotNull(), F.struct("ordinal", "fault"))).alias("_first"))
    found = found.join(roots(records.select("segment", F.col("ordinal").alias("at"), "digest"), ["segment"]), "segment")
    was = committed.select("segment", F.col("records").alias("_records"), F.col("root").alias("_root"))
    both = found.join(was, "segment", "full")
    verdict = (
        F.when(F.col("records").isNull(), "segment_missing").when(F.col("_first").isNotNull(), F.col("_first.fault")).when(F.col("_records").isNull(), "segment_unknown")
        .when(F.col("records") != F.col("_records"), "count_differs").when(F.col("root") != F.col("_root"), "root_differs").otherwise("ok")
    )
    return both.select("segment", F.coalesce("records", F.lit(0)).alias("records"), F.col("_first.ordinal").alias("first_fault"), verdict.alias("verdict"))


def heads(committed: DataFrame, archive: str, place: str) -> DataFrame:
    """(archive, segments, head) over manifests: the tree of the segments' roots in order, so that a segment can't be dropped, changed or moved."""
    tops = roots(committed.select(archive, F.col(place).alias("at"), F.col("root").alias("digest")), [archive])
    return committed.groupBy(archive).agg(F.count("*").alias("segments")).join(tops.withColumnRenamed("root", "head"), archive)


def rotated(records: DataFrame, key: str, order: list[str], at: str, size: Column, most_records: int, most_bytes: int, most_age: int) -> DataFrame:
    """``records`` with ``segment_no`` (from 0 per key) and ``place`` in it, as a writer cuts them in order.

    A segment ends with the record that makes it ``most_records`` or ``most_bytes``, and before one that comes
    ``most_age`` or more after its first. Cuts hang on the one before, so records are folded in order; but a record
    that comes ``most_age`` after the one before it always starts a segment, so a key is dealt out by such stretches.
    Rows that repeat are records each; a record without a time belongs to the stretch before it and has no age.
    """
    by = Window.partitionBy(key).orderBy(*order)
    fresh = F.coalesce(F.col(at) - F.lag(at).over(by) >= most_age, F.lit(False))
    rows = records.withColumn("_bytes", F.coalesce(size.cast("long"), F.lit(0))).withColumn("_stretch", F.sum(fresh.cast("int")).over(by)).withColumn("_turn", F.row_number().over(by))
    out = T.StructType([*rows.schema.fields, T.StructField("_no", T.LongType()), T.StructField("place", T.LongType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, no, n, total, opened = None, 0, 0, 0, None
        for rows in batches:
            numbers, places = [], []
            for k, stretch, t, size in zip(rows[key], rows["_stretch"], rows[at], rows["_bytes"], strict=True):
                mark = (None if pd.isna(k) else k, stretch)
                if mark != last:
                    last, no, n, total, opened = mark, 0, 0, 0, None
                elif n >= most_records or total >= most_bytes or (opened is not None and not pd.isna(t) and t - opened >= most_age):
                    no, n, total, opened = no + 1, 0, 0, None
                opened = opened if opened is not None or pd.isna(t) else t
                numbers.append(no)
                places.append(n)
                n, total = n + 1, total + size
            yield rows.assign(_no=numbers, place=places)

    cut = rows.repartition(key, "_stretch").sortWithinPartitions(key, "_stretch", "_turn").mapInPandas(fold, out)
    # segments before a stretch: summed over the key's stretches, which are fewer than its records
    stretches = cut.groupBy(key, "_stretch").agg((F.max("_no") + 1).alias("_segments"))
    before = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stretches.withColumn("_before", F.coalesce(F.sum("_segments").over(before), F.lit(0))).select(F.col(key).alias("_key"), F.col("_stretch").alias("_of"), "_before")
    numbered = cut.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_stretch") == F.col("_of")))
    return numbered.select(*records.columns, (F.col("_no") + F.col("_before")).alias("segment_no"), "place")
