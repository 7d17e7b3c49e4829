"""Amounts that are known, or absent for a reason: structs of value and reason, of which one is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a signature costs, and micro-units in a unit.
PER_SIGNATURE, MICRO = 5000, 1_000_000


def maybe(value: Column, reason: Column) -> Column:
    """The value, or where it is null the reason."""
    return F.struct(value.cast("long").alias("value"), F.when(value.isNull(), reason).alias("reason"))


def known(m: Column) -> Column:
    return m["reason"].isNull()


def combined(*terms: Column) -> Column:
    """The sum of the terms; with an absent term it is absent, for the reason of the first such term, and never the sum of the others."""
    total = terms[0]["value"]
    for t in terms[1:]:
        total = total + t["value"]
    return maybe(total, F.coalesce(*[t["reason"] for t in terms]))


def base_fee(signatures: Column) -> Column:
    return maybe(signatures * PER_SIGNATURE, F.lit("not_reconstructable"))


def residual_fee(total: Column, base: Column) -> Column:
    """What is left of the fee after the base fee; below zero the two contradict each other, and it is not taken for zero."""
    left = total["value"] - base["value"]
    return maybe(F.when(left >= 0, left), F.coalesce(total["reason"], base["reason"], F.lit("conflicting_sources")))


def budget_fee(price: Column, limit: Column) -> Column:
    """Price times limit, rounded up to whole units; without a price instruction nothing was asked for, which is known."""
    asked = F.ceil((price["value"] * limit["value"]).cast("decimal(38,0)") / MICRO).cast("long")
    none = price["reason"] == "not_provided"
    return maybe(F.when(F.coalesce(none, F.lit(False)), F.lit(0)).otherwise(asked), F.coalesce(price["reason"], limit["reason"]))


def reconciled(residual: Column, budget: Column, tolerance: int = 1) -> Column:
    """The residual if both agree, else a contradiction; where one is absent the other one stands alone."""
    both = known(residual) & known(budget)
    apart = both & (F.abs(residual["value"] - budget["value"]) > tolerance)
    value = F.when(~apart, F.coalesce(residual["value"], budget["value"]))
    return maybe(value, F.when(apart, "conflicting_sources").otherwise(residual["reason"]))
