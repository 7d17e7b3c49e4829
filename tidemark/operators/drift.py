"""What moved between pinned records and those of now, by digests of a canonical subset of their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _told(c: Column) -> Column:
    """A field's text, missing and empty apart."""
    return F.when(c.isNull(), "-").otherwise(F.concat(F.lit("+"), c.cast("string")))


def subset_digest(fields: list[str], of: str = "") -> Column:
    """The digest of the named fields, by name; what else a record has doesn't count."""
    return F.sha2(F.concat_ws("\n", *[F.concat(F.lit(f"{f}="), _told(F.col(f"{of}{f}"))) for f in sorted(fields)]), 256)


def drift(pinned: DataFrame, live: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per key: state, changed (names of fields, sorted), pinned_digest and live_digest.

    unchanged or drifted where both are there; unknown where nothing live was had, as a fetch that failed is no drift; unpinned where there is
    no pinned record. Only digests and fields of keys on both sides are compared, by one join. Keys are distinct on each side; rows without a key
    are left out, as nothing can be held against them.
    """
    side = lambda df, name: df.where(F.col(key).isNotNull()).select(F.col(key), F.struct(*fields).alias(name), subset_digest(fields).alias(f"{name}_digest"))
    both = side(pinned, "pinned").join(side(live, "live"), key, "full")
    changed = F.filter(F.array(*[F.when(~F.col(f"pinned.{f}").eqNullSafe(F.col(f"live.{f}")), f) for f in sorted(fields)]), lambda x: x.isNotNull())
    here = F.col("pinned_digest").isNotNull() & F.col("live_digest").isNotNull()
    state = F.when(F.col("live_digest").isNull(), "unknown").when(F.col("pinned_digest").isNull(), "unpinned").when(F.col("pinned_digest") == F.col("live_digest"), "unchanged").otherwise("drifted")
    return both.select(key, state.alias("state"), F.when(here & (state == "drifted"), changed).otherwise(F.array().cast("array<string>")).alias("changed"), "pinned_digest", "live_digest")
