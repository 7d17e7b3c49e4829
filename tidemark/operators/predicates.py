"""Typed predicate documents compiled to columns, in three-valued logic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {
    "eq": lambda c, v: c == v, "not_eq": lambda c, v: c != v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(*v), "not_in": lambda c, v: ~c.isin(*v), "exists": lambda c, v: c.isNotNull(), "not_exists": lambda c, v: c.isNull(),
}


class PredicateError(ValueError):
    """The document is not valid for the table."""


@dataclass(frozen=True)
class Clause:
    field: str
    operator: str
    value: object = None

    def column(self) -> Column:
        return COMPARE[self.operator](F.col(self.field), self.value)


def parse(document: dict, fields: set[str], floor: Clause | None = None) -> tuple[list[Clause], list[Clause]]:
    """The clauses of 'all' and 'none'. Unknown keys, fields or operators are refused; ``floor`` joins 'all' unless it is there."""
    if extra := set(document) - {"all", "none"}:
        raise PredicateError(f"unknown keys: {sorted(extra)}")
    parts = []
    for key in ("all", "none"):
        clauses = [Clause(c.get("field"), c.get("operator"), c.get("value")) for c in document.get(key, [])]
        for c in clauses:
            if c.field not in fields or c.operator not in COMPARE:
                raise PredicateError(f"{key}: {c}")
            if c.operator in ("in", "not_in") and (not isinstance(c.value, list) or not c.value):
                raise PredicateError(f"{key}: a list is needed: {c}")
            if c.operator not in ("exists", "not_exists") and c.value is None:
                raise PredicateError(f"{key}: a value is needed: {c}")
        parts.append(clauses)
    if floor is not None and floor not in parts[0]:
        parts[0].append(floor)
    return parts[0], parts[1]


def evaluate(rows: DataFrame, document: dict, floor: Clause | None = None) -> DataFrame:
    """``member`` and ``kept_unknown``: every clause of 'all' must be true; one of 'none' vetoes only if true.

    kept_unknown counts the vetoes that were not applied because their field is unknown.
    """
    required, vetoes = parse(document, set(rows.columns), floor)
    member, unknown = F.lit(True), F.lit(0)
    for c in required:
        member = member & F.coalesce(c.column(), F.lit(False))
    for c in vetoes:
        member = member & ~F.coalesce(c.column(), F.lit(False))
        unknown = unknown + F.when(c.column().isNull(), 1).otherwise(0)
    return rows.withColumn("member", member).withColumn("kept_unknown", unknown)


def membership_digest(rows: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """A digest of the set of keys that does not hang on order or partitions: per part of the keys' hash, then over the parts.

    A part's keys are sorted and hashed where they meet, so no task holds the whole list.
    """
    text = F.col(key).cast("string")
    part = F.pmod(F.crc32(F.encode(text, "UTF-8")), F.lit(parts))
    per = rows.select(text.alias("k"), part.alias("part")).distinct().groupBy("part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("k")), ","), 256).alias("digest"), F.count("*").alias("n"))
    return per.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"]), ","), 256).alias("digest"), F.sum("n").alias("n"))
