"""Secret scans with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_name, written


@dataclass(frozen=True)
class Kind:
    """A pattern; ``value``: its group that must have ``least`` characters (0: the whole match)."""

    name: str
    pattern: str
    value: int = 0
    least: int = 1


#: Found wherever they stand.
STRONG = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}", 0, 20),  # as many characters as AKIA[A-Z0-9]+ takes, of 20 or more
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Reported only where the parts that complete them lie in their scope.
WEAK = (
    Kind("id", r"""((?i:client_?id|access_?key_?id|account_?id|user_?name|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 3),
    Kind("key", r"[A-Za-z0-9+/]{32,}", 0, 32),
    Kind("endpoint", r"""((?:https?|jdbc:[a-z]+|postgres|mysql|redis|mongodb|amqp)://)([A-Za-z0-9.:_-]+)""", 2, 4),
)
#: Parts lie in one scope when at most so many code points lie between them; parts that overlap have none between.
SCOPE = 256
#: Spans, and four more a document, that are broadcast to the texts they mask (16 bytes each, about).
BROADCAST_SPANS = 1_000_000
IDENTIFIERS, SECRETS = ("access", "id"), ("assign", "hex", "key")


def _parts(kind: int, pattern: str) -> Column:
    """Each match with the length of the text before it since the last one, in order; the last entry has no match."""
    gaps = F.transform(F.split("text", pattern, -1), F.length)
    zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"), gaps.alias("gap"))
    return F.transform(zipped, lambda x: F.struct(F.lit(kind).alias("kind"), x["found"].alias("found"), x["gap"].cast("long").alias("gap")))


def find_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document with its spans: doc_id, text_key (a hash of the text), spans.

    ``spans`` is an array of (start, kind, end, name) in order, by code points with the end
    exclusive; ``kind`` numbers the kinds as listed. A weak span is there only if complementary parts
    lie within ``scope`` of it: for an identifier a secret, for a bare key an identifier, for an
    endpoint both. The parts of a document are joined by intervals: of those that start no later the
    one that ends last, of those that start no earlier the one that starts first is the nearest, so running
    extremes answer it and no pair of parts is ever made. Only matches and one row per document are shuffled.

    A null or empty text has no spans, repeated rows give a row each, a null doc_id stays null, an empty
    table gives no rows; further columns are ignored.
    """
    kinds = (*STRONG, *WEAK)
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    none = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(None).cast("string").alias("found"), F.lit(0).cast("long").alias("gap")))
    parts = row.select("doc_id", "row", F.xxhash64("text").alias("text_key"), F.posexplode(F.concat(none, *[_parts(i, k.pattern) for i, k in enumerate(kinds)])).alias("pos", "part"))
    parts = parts.select("doc_id", "row", "text_key", "pos", "part.*").where("kind < 0 or found is not null")
    order = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.repartition("row")
    size = F.length("found")
    end = F.when(F.col("kind") >= 0, F.sum(F.col("gap") + size).over(order))
    placed = parts.withColumn("end", end).withColumn("start", F.col("end") - size)
    value = F.lit(None).cast("string")
    for i, k in enumerate(kinds):
        value = F.when(F.col("kind") == i, F.regexp_extract("found", k.pattern, k.value) if k.value else F.col("found")).otherwise(value)
    least = F.element_at(F.array(*[F.lit(k.least) for k in kinds]), F.col("kind") + 1)
    first_weak, key = len(STRONG), [k.name for k in kinds].index("key")
    fit = F.length("value") >= least
    mixed = (F.col("kind") != key) | (F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[0-9]"))
    spans = placed.withColumn("value", value).where((F.col("kind") < 0) | (fit & mixed))
    running = lambda by: Window.partitionBy("row").orderBy(by).rangeBetween(Window.unboundedPreceding, 0)
    named = lambda names: F.col("kind").isin([i for i, k in enumerate(kinds) if k.name in names])
    before = lambda names: F.max(F.when(named(names), F.col("end"))).over(running(F.col("start").asc())) >= F.col("start") - scope
    after = lambda names: F.min(F.when(named(names), F.col("start"))).over(running(F.col("start").desc())) <= F.col("end") + scope
    has = lambda names: F.coalesce(before(names), F.lit(False)) | F.coalesce(after(names), F.lit(False))
    spans = spans.withColumn("with_id", has(IDENTIFIERS)).withColumn("with_secret", has(SECRETS))
    linked = F.when(named(("id",)), F.col("with_secret")).when(named(("key",)), F.col("with_id")).otherwise(F.col("with_id") & F.col("with_secret"))
    kept = spans.where((F.col("kind") < first_weak) | linked)
    name = F.element_at(F.array(*[F.lit(k.name) for k in kinds]), F.greatest(F.col("kind") + 1, F.lit(1)))
    span = F.when(F.col("kind") >= 0, F.struct("start", "kind", "end", name.alias("name")))
    return kept.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.array_sort(F.collect_list(span)).alias("spans")).drop("row")


def joined_spans(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])))


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256 and spans (strong and linked weak ones).

    A null or empty text has no spans; repeated rows each give a row; a null doc_id stays null; an
    empty table gives no rows; further columns are ignored.
    """
    found = find_spans(docs, scope)
    base = F.filter("spans", lambda s: s["kind"] < len(STRONG))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(i).alias(f"n_{k.name}") for i, k in enumerate(STRONG)]
    return found.select("doc_id", *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every span replaced by ``mask``; overlapping spans become one mask, other columns stay.

    n_chars follows the new text, where there is such a column. Null texts stay null, rows without a
    doc_id and repeated rows are masked each, an empty table gives no rows, further columns stay as
    they are, whatever their names. The spans are written first: as long as they are few (BROADCAST_SPANS) they go to the
    texts, beyond that the texts are shuffled to them.
    """
    doc_id, key, at = (new_name(docs, x) for x in ("span_doc", "span_key", "spans"))
    merge = lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("from"), s["start"].alias("to"))))).otherwise(acc["out"]).alias("out"))
    none = F.array().cast("array<struct<from: long, to: long>>")
    # what stays: from the end of one mask to the start of the next, and the end of the last
    kept = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), merge)
    spans = find_spans(docs, scope).where(F.size("spans") > 0).select(F.col("doc_id").alias(doc_id), F.col("text_key").alias(key), kept.alias(at))
    spans = written(spans.dropDuplicates([doc_id, key]), "spans")
    if (spans.agg(F.sum(F.size(F.col(at)["out"]) + 4)).first()[0] or 0) <= BROADCAST_SPANS:
        spans = F.broadcast(spans)
    piece = lambda x: F.substring(F.col("text"), x["from"].cast("int") + 1, (x["to"] - x["from"]).cast("int"))
    cut = F.concat(F.array_join(F.transform(F.col(at)["out"], piece), mask), F.lit(mask), F.substring(F.col("text"), F.col(at)["at"].cast("int") + 1, F.length("text")))
    keyed = docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(key)), "left")
    out = keyed.withColumn("text", F.when(F.col(at).isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(at).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)
