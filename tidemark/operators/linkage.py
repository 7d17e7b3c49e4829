"""Links of markets to fixtures by codes and dates, exact before fuzzy, never by closeness of time alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _pair(a: Column, b: Column) -> Column:
    """One key for two codes in either order; null where one is unknown."""
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("|", F.lit("pair"), F.least(a, b), F.greatest(a, b)))


def _codes(a: Column, b: Column) -> Column:
    """The distinct codes where both are known, as keys; else none."""
    return F.when(a.isNotNull() & b.isNotNull(), F.array_distinct(F.array(F.concat(F.lit("code|"), a), F.concat(F.lit("code|"), b)))).otherwise(F.array().cast("array<string>"))


def link_fixtures(markets: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Per market (id, kind, day, a, b) its label, basis and fixture; fixtures: id, day, a, b.

    Both codes on the day, else on the day after, else on the day before, are a link; several such
    fixtures are ambiguous, and the smallest id is named. Exactly one fixture of the day itself with one
    of the codes is a candidate. Fixtures are counted by day and key first, so a market meets at most
    six counts, never other rows.
    """
    day, a, b = F.col("day"), F.col("a"), F.col("b")
    keys = F.array_compact(F.concat(F.array(F.lit("day"), _pair(a, b)), _codes(a, b)))
    counts = fixtures.select("day", "id", F.explode(keys).alias("k")).groupBy("day", "k").agg(F.count("*").alias("n"), F.min("id").alias("fixture"))
    probe = lambda shift, key, rank: F.struct(F.date_add(day, shift).alias("day"), key.alias("k"), F.lit(rank).alias("rank"))
    days = [(0, 0), (1, 1), (-1, 2)]
    whole = F.array(*[probe(s, F.lit("day"), r) for s, r in days], *[probe(s, _pair(a, b), r) for s, r in days])
    probes = F.concat(whole, F.transform(_codes(a, b), lambda c: F.struct(day.alias("day"), c.alias("k"), F.lit(0).alias("rank"))))
    parsed = F.col("kind").eqNullSafe("match_winner") & day.isNotNull()
    asked = markets.where(parsed).select("id", F.inline(probes)).where("k IS NOT NULL")
    met = asked.join(counts, ["day", "k"])
    of = lambda kind: F.col("k").startswith(kind)
    found = met.groupBy("id").agg(
        F.bool_or(of("day")).alias("fetched"), F.min_by(F.when(of("pair"), F.struct("n", "fixture", "rank")), F.when(of("pair"), F.col("rank"))).alias("both"),
        F.sum(F.when(of("code"), F.col("n"))).alias("single"), F.min(F.when(of("code"), F.col("fixture"))).alias("partial"),
    )
    exact, one = F.col("both.n") == 1, F.col("single") == 1
    fetched = F.coalesce("fetched", F.lit(False))
    basis = (
        F.when(~F.col("kind").eqNullSafe("match_winner"), "other_kind").when(day.isNull(), "no_date").when(~fetched, "day_not_fetched").when(_pair(a, b).isNull(), "no_codes")
        .when(exact, F.when(F.col("both.rank") == 0, "codes_and_day").otherwise("codes_and_adjacent_day")).when(F.col("both.n") > 1, "ambiguous").when(one, "one_code").otherwise("none")
    )
    label = (
        F.when(basis == "other_kind", "incompatible_market_type").when(basis.isin("no_date", "day_not_fetched", "no_codes"), "unresolved")
        .when(basis.startswith("codes"), "source_backed_link").when(basis.isin("ambiguous", "one_code"), "fuzzy_candidate").otherwise("provider_no_match")
    )
    named = F.when(basis.startswith("codes") | (basis == "ambiguous"), F.col("both.fixture")).when(basis == "one_code", F.col("partial"))
    return markets.join(found, "id", "left").select("id", label.alias("label"), basis.alias("basis"), named.alias("fixture"))


def feasible_pairs(members: DataFrame, group: str, width: int, grace: int, margin: int) -> DataFrame:
    """Per member (group, id, open, ready): ``overlapping`` and ``usable`` partners, and the usable ``partner`` that is ready first and opens no earlier.

    A member's window is [open, open + width]. Two can be used together if, at the deadline of the one that opens first (its
    close, less ``grace`` and ``margin``), both are ready, and the other is open ``margin`` later at the latest. Members of a group meet
    by stretches of ``width``, in running counts: all that open before a member that makes its own deadline make its
    deadline too, so counts of those ready by a deadline, less those opened before, are the partners, and no pair is made.

    Rows that repeat count each; a member that misses its own deadline, or isn't ready at all, is never usable; members without an open time have no window
    and no partners; null groups are one group.
    """
    after = width - grace - margin  # from an open to its deadline
    one = Window.partitionBy(group, "_part").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    own = F.floor(F.col("open") / width)
    columns = members.columns
    # overlapping: opens in [open - width, open + width], itself left out
    rows = members.where("open is not null").withColumn("_n", F.monotonically_increasing_id())
    copies = rows.select(group, F.explode(F.array(own - 1, own, own + 1)).alias("_part"), F.col("open").alias("_at"), F.lit(0).alias("_side"), F.lit(1).alias("_one"))
    edges = F.explode(F.array(F.struct((F.col("open") + width).alias("at"), F.lit(1).alias("sign")), F.struct((F.col("open") - width - 1).alias("at"), F.lit(-1).alias("sign")))).alias("_e")
    ends = rows.select(group, own.alias("_part"), "_n", F.struct(*columns).alias("_row"), edges)
    ends = ends.select(group, "_part", "_n", F.when(F.col("_e.sign") == 1, F.col("_row")).alias("_row"), F.col("_e.at").alias("_at"), F.col("_e.sign").alias("_sign"), F.lit(1).alias("_side"), F.lit(0).alias("_one"))
    seen = copies.unionByName(ends, allowMissingColumns=True).withColumn("_seen", F.sum("_one").over(one)).where("_side = 1")
    met = seen.groupBy(group, "_part", "_n").agg(F.any_value("_row", True).alias("_row"), (F.sum(F.col("_seen") * F.col("_sign")) - 1).alias("overlapping")).select("_row.*", "overlapping")
    met = met.withColumn("armed", F.coalesce(F.col("ready") <= F.col("open") + after, F.lit(False)))
    # usable, as the one that opens first: of the armed in this stretch and the next, those ready by the deadline less those that open no later
    laid = met.where("armed").withColumn("_k", F.greatest(F.col("open") - margin, F.col("ready"))).withColumn("_of", own).withColumn("_part", F.explode(F.array(F.col("_of"), F.col("_of") - 1)))
    by_open = Window.partitionBy(group, "_part").orderBy("open", "id").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(group, "_part").orderBy(F.desc("open"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    places = laid.withColumn("_before", F.row_number().over(by_open)).withColumn("_next", F.min(F.struct("_k", "id")).over(later))
    out = [*columns, "armed", "overlapping"]
    due = places.where("_of = _part").select(group, "_part", F.struct(*out).alias("_row"), "_before", "_next", (F.col("open") + after).alias("_at"), F.lit(1).alias("_side"), F.lit(0).alias("_one"))
    ready = places.select(group, "_part", F.col("_k").alias("_at"), F.lit(0).alias("_side"), F.lit(1).alias("_one"))
    counted = ready.unionByName(due, allowMissingColumns=True).withColumn("_seen", F.sum("_one").over(one)).where("_side = 1")
    usable = counted.select("_row.*", (F.col("_seen") - F.col("_before")).alias("usable"), F.when(F.col("_next._k") <= F.col("_at"), F.col("_next.id")).alias("partner"))
    never = met.where("not armed").select(*out, F.lit(0).cast("long").alias("usable"), F.lit(None).cast(members.schema["id"].dataType).alias("partner"))
    return usable.unionByName(never)
