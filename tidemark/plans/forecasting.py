"""Calibration, cohorts with unknown outcomes, representation, paired comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L
from ..functions import scoring as S
from ..functions import stats
from ..operators import calibration as C
from .registry import FORECASTS, forecasts, query, table

_BIN = "CASE " + " ".join(f"WHEN p / 1000.0::DOUBLE >= {k / 10}::DOUBLE THEN {k}" for k in range(9, 0, -1)) + " ELSE 0 END"
_BINNED = f"b AS (SELECT {_BIN} AS bin, count(*) AS n, CAST(sum(p) AS BIGINT) AS sum_p, CAST(sum(y) AS BIGINT) AS yes, CAST(sum((p - 1000 * y) * (p - 1000 * y)) AS BIGINT) AS sum_brier FROM forecasts GROUP BY 1)"
_DIRECTION = """CASE WHEN abs(round(mean_p - rate, 6)) <= 0.05 THEN 'approximately_calibrated' WHEN mean_p >= 0.5 AND round(mean_p - rate, 6) > 0 THEN 'overconfident_positive' WHEN mean_p >= 0.5 THEN 'underconfident_positive' WHEN round(mean_p - rate, 6) < 0 THEN 'overconfident_negative' ELSE 'underconfident_negative' END"""
_RELIABLE = f"r AS (SELECT *, sum_p::DOUBLE / n / 1000 AS mean_p, yes::DOUBLE / n AS rate FROM b), d AS (SELECT *, {_DIRECTION} AS direction FROM r)"


@query(f"""WITH {FORECASTS}, {_BINNED}, {_RELIABLE}, w AS (SELECT *, 1 + 3.8416::DOUBLE / n AS sc, rate + 3.8416::DOUBLE / (2 * n) AS mid, sqrt(rate * (1 - rate) / n + 3.8416::DOUBLE / (4 * n * n)) AS sq FROM d)
SELECT bin, n, sum_p, yes, sum_brier, mean_p, rate, mean_p - rate AS gap, greatest(0, mid / sc - 1.96 / sc * sq) AS low, least(1, mid / sc + 1.96 / sc * sq) AS high, direction, CASE WHEN n < 3 THEN 'too_thin' WHEN n < 10 THEN 'descriptive_only' ELSE 'measured' END AS label FROM w""")
def reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    """A16, P13."""
    return C.reliability(C.bins(forecasts(spark, d)))


@query(f"""WITH {FORECASTS}, {_BINNED}, g AS (SELECT n, abs(sum_p / 1000.0::DOUBLE - yes) AS gap FROM b)
SELECT CAST(sum(n) AS BIGINT) AS n, sum(gap) / sum(n) AS ece, coalesce(max(gap / n) FILTER (WHERE n >= 10), max(gap / n)) AS mce, CASE WHEN max(n) >= 10 THEN 'measured' ELSE 'fallback_populated' END AS mce_source, count(*) AS populated_bins FROM g""")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    """A17, A45."""
    return C.errors(C.bins(forecasts(spark, d)))


@query(f"""WITH {FORECASTS}, t AS (SELECT avg(y) AS base, count(*) AS n, avg((p / 1000.0::DOUBLE - y) ** 2) AS brier FROM forecasts), {_BINNED}, {_RELIABLE},
s AS (SELECT sum(d.n * (mean_p - rate) ** 2) / max(t.n) AS reliability, sum(d.n * (rate - base) ** 2) / max(t.n) AS resolution, max(base * (1 - base)) AS uncertainty, max(brier) AS brier, max(t.n) AS n FROM d, t)
SELECT n, round(reliability, 9) AS reliability, round(resolution, 9) AS resolution, round(uncertainty, 9) AS uncertainty, round(brier, 9) AS brier, round(brier - (reliability - resolution + uncertainty), 9) AS residual FROM s""")
def murphy_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """Rounded to nine places, as the parts are sums of quotients."""
    out = C.decomposition(C.bins(forecasts(spark, d)))
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("reliability", "resolution", "uncertainty", "brier", "residual")])


@query(f"""WITH {FORECASTS}, s AS (SELECT lang, count(*) AS n, sum((p - 1000 * y) * (p - 1000 * y))::DOUBLE / 1000000 / count(*) AS brier, sum(y)::DOUBLE / count(*) AS base FROM forecasts GROUP BY 1)
SELECT lang, n, brier, base AS base_rate, 1 - brier / 0.25 AS skill_vs_half, CASE WHEN base * (1 - base) > 0 THEN 1 - brier / (base * (1 - base)) END AS skill_vs_base FROM s""")
def baseline_skill(spark: SparkSession, d: str) -> DataFrame:
    """Against always one half and against the base rate, by language."""
    return C.skill(forecasts(spark, d), ["lang"])


@query(f"""WITH {FORECASTS}, {_BINNED}, {_RELIABLE}, s AS (SELECT CAST(round(coalesce(sum(n) FILTER (WHERE direction LIKE 'over%'), 0) * 10000.0::DOUBLE / sum(n)) AS BIGINT) AS o, CAST(round(coalesce(sum(n) FILTER (WHERE direction LIKE 'under%'), 0) * 10000.0::DOUBLE / sum(n)) AS BIGINT) AS u, CAST(round(coalesce(sum(n) FILTER (WHERE direction LIKE 'approx%'), 0) * 10000.0::DOUBLE / sum(n)) AS BIGINT) AS c FROM d)
SELECT o + CASE WHEN o >= greatest(u, c) THEN 10000 - o - u - c ELSE 0 END AS "over", u + CASE WHEN o < greatest(u, c) AND u >= c THEN 10000 - o - u - c ELSE 0 END AS "under", c + CASE WHEN o < c AND u < c THEN 10000 - o - u - c ELSE 0 END AS calibrated FROM s""")
def directional_shares(spark: SparkSession, d: str) -> DataFrame:
    """A20."""
    return C.directional_shares(C.bins(forecasts(spark, d)))


@query(f"""WITH {FORECASTS}, b AS (SELECT source, {_BIN} AS bin, count(*) AS n, sum(p) AS sum_p, sum(y) AS yes FROM forecasts GROUP BY 1, 2), g AS (SELECT source, n, abs(sum_p / 1000.0::DOUBLE - yes) AS gap FROM b)
SELECT source, CAST(sum(n) AS BIGINT) AS n, sum(gap) / sum(n) AS ece, coalesce(max(gap / n) FILTER (WHERE n >= 10), max(gap / n)) AS mce, CASE WHEN max(n) >= 10 THEN 'measured' ELSE 'fallback_populated' END AS mce_source, count(*) AS populated_bins FROM g GROUP BY 1 HAVING sum(n) >= 5""")
def cohort_reliability(spark: SparkSession, d: str) -> DataFrame:
    """Errors per source, of those with forecasts enough."""
    return C.errors(C.bins(forecasts(spark, d), ["source"]), ["source"]).where("n >= 5")


@query(f"""WITH {FORECASTS}, x AS (SELECT unnest([{{'f': 'lang', 'v': lang}}, {{'f': 'toxic', 'v': CAST(toxic AS VARCHAR)}}, {{'f': 'band', 'v': CASE WHEN p < 500 THEN 'low' ELSE 'high' END}}]) AS tag, p, y FROM forecasts)
SELECT tag.f AS family, tag.v AS value, count(*) AS n, sum((p - 1000 * y) * (p - 1000 * y))::DOUBLE / 1000000 / count(*) AS brier, sum(abs(p - 1000 * y))::DOUBLE / 1000 / count(*) AS absolute_error FROM x GROUP BY 1, 2""")
def calibration_summary(spark: SparkSession, d: str) -> DataFrame:
    """Scores by each family of tags; a forecast counts in every family."""
    tags = F.array(*[F.struct(F.lit(f).alias("family"), v.alias("value")) for f, v in (("lang", F.col("lang")), ("toxic", F.col("toxic").cast("string")), ("band", F.when(F.col("p") < 500, "low").otherwise("high")))])
    e = F.col("p") - 1000 * F.col("y")
    each = forecasts(spark, d).select(F.explode(tags).alias("tag"), e.alias("e")).select("tag.*", "e")
    return each.groupBy("family", "value").agg(F.count("*").alias("n"), (F.sum(F.col("e") * F.col("e")) / F.lit(1e6) / F.count("*")).alias("brier"), (F.sum(F.abs("e")) / F.lit(1000.0) / F.count("*")).alias("absolute_error"))


_OUTCOMES = "o AS (SELECT d.lang, d.source, CASE WHEN l.doc_id IS NULL THEN NULL ELSE l.quality = 1 END AS good FROM documents d LEFT JOIN labels l USING (doc_id))"


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    known = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    return docs.join(known, "doc_id", "left")


@query(f"""WITH {_OUTCOMES} SELECT lang, source, count(*) AS n, CAST(count(*) FILTER (WHERE good) AS BIGINT) AS yes, CAST(count(*) FILTER (WHERE NOT good) AS BIGINT) AS no, CAST(count(*) FILTER (WHERE good IS NULL) AS BIGINT) AS unknown, CASE WHEN count(good) >= 6 THEN count(*) FILTER (WHERE good)::DOUBLE / count(good) END AS rate, CASE WHEN count(*) >= 12 THEN 'measured' ELSE 'too_thin' END AS label FROM o GROUP BY 1, 2""")
def three_valued_rates(spark: SparkSession, d: str) -> DataFrame:
    """Unknown outcomes never enter a rate, and a rate needs six known ones."""
    yes, no = stats.count_where(F.col("good")), stats.count_where(~F.col("good"))
    return _outcomes(spark, d).groupBy("lang", "source").agg(
        F.count("*").alias("n"), yes.alias("yes"), no.alias("no"), stats.count_where(F.col("good").isNull()).alias("unknown"),
        F.when(F.count("good") >= 6, yes / F.count("good")).alias("rate"), F.when(F.count("*") >= 12, "measured").otherwise("too_thin").alias("label"),
    )


@query(f"""WITH {_OUTCOMES}, c AS (SELECT 'lang' AS dim, lang AS v, good FROM o UNION ALL SELECT 'source', source, good FROM o), r AS (SELECT dim, v, count(*) AS n, count(good) AS known, CASE WHEN count(good) >= 6 THEN count(*) FILTER (WHERE good)::DOUBLE / count(good) END AS rate FROM c GROUP BY 1, 2 HAVING count(*) >= 12),
s AS (SELECT dim, count(*) AS cohorts, CASE WHEN count(rate) >= 2 THEN max(rate) - min(rate) END AS delta, sum(known)::DOUBLE / sum(n) AS known_share FROM r GROUP BY 1)
SELECT dim, cohorts, delta, known_share, CASE WHEN cohorts < 2 THEN 'too_thin' WHEN known_share < 0.3 OR delta IS NULL THEN 'provider_gap_dominates' WHEN delta >= 0.25 THEN 'strong' WHEN delta >= 0.10 THEN 'weak' ELSE 'none' END AS label FROM s""")
def separation(spark: SparkSession, d: str) -> DataFrame:
    """Of A32 the spread of measured cohort rates per dimension, thin and unmeasured ones said first; source_stratification reads it by kind of source."""
    dims = F.array(*[F.struct(F.lit(x).alias("dim"), F.col(x).alias("v")) for x in ("lang", "source")])
    each = _outcomes(spark, d).select(F.explode(dims).alias("g"), "good").select("g.*", "good")
    by = each.groupBy("dim", "v").agg(F.count("*").alias("n"), F.count("good").alias("known"), F.when(F.count("good") >= 6, stats.count_where(F.col("good")) / F.count("good")).alias("rate")).where("n >= 12")
    out = by.groupBy("dim").agg(F.count("*").alias("cohorts"), F.when(F.count("rate") >= 2, F.max("rate") - F.min("rate")).alias("delta"), (F.sum("known") / F.sum("n")).alias("known_share"))
    delta = F.col("delta")
    return out.withColumn("label", L.first_reason([(F.col("cohorts") < 2, "too_thin"), ((F.col("known_share") < 0.3) | delta.isNull(), "provider_gap_dominates"), (delta >= 0.25, "strong"), (delta >= 0.10, "weak")], "none"))


@query(f"""WITH {_OUTCOMES}, c AS (SELECT source, count(*) AS n, count(good) AS scored FROM o GROUP BY 1), t AS (SELECT source, n, scored, n::DOUBLE / sum(n) OVER () AS share_all, scored::DOUBLE / nullif(sum(scored) OVER (), 0) AS share_scored FROM c)
SELECT source, n, scored, share_all, share_scored, CASE WHEN 100 * (share_scored - share_all) > 2 THEN 'over' WHEN 100 * (share_scored - share_all) < -2 THEN 'under' ELSE 'even' END AS label FROM t""")
def representation(spark: SparkSession, d: str) -> DataFrame:
    """Each source's share among the scored against its share of all, in points."""
    by = _outcomes(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count("good").alias("scored"))
    total = by.agg(F.sum("n").alias("all_n"), F.sum("scored").alias("all_scored"))
    t = by.join(F.broadcast(total)).select("source", "n", "scored", (F.col("n") / F.col("all_n")).alias("share_all"), stats.rate(F.col("scored"), F.nullif("all_scored", F.lit(0))).alias("share_scored"))
    points = 100 * (F.col("share_scored") - F.col("share_all"))
    return t.withColumn("label", F.when(points > 2, "over").when(points < -2, "under").otherwise("even"))


@query("""WITH x AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS labelled, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 0, false) AS clean, d.n_chars >= 500 AS long FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT count(*) AS population, CAST(count(*) FILTER (WHERE labelled) AS BIGINT) AS labelled, CAST(count(*) FILTER (WHERE labelled AND good) AS BIGINT) AS good, CAST(count(*) FILTER (WHERE labelled AND good AND clean) AS BIGINT) AS clean, CAST(count(*) FILTER (WHERE labelled AND good AND clean AND long) AS BIGINT) AS long FROM x""")
def funnel(spark: SparkSession, d: str) -> DataFrame:
    """Each step among those of the one before."""
    known = table(spark, d, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("has"))
    x = table(spark, d, "documents").select("doc_id", "n_chars").join(known, "doc_id", "left")
    steps, so_far, out = {"labelled": F.col("has"), "good": F.col("quality") == 1, "clean": F.col("toxic") == 0, "long": F.col("n_chars") >= 500}, F.lit(True), []
    for name, step in steps.items():
        so_far = so_far & F.coalesce(step, F.lit(False))
        out.append(stats.count_where(so_far).alias(name))
    return x.agg(F.count("*").alias("population"), *out)


@query(f"""WITH {FORECASTS}, c AS (SELECT id, CASE WHEN y = 1 THEN p / 1000.0::DOUBLE END AS a, CASE WHEN toxic = 1 THEN 0.9::DOUBLE END AS b, (id % 7) / 7.0::DOUBLE AS c FROM forecasts),
m AS (SELECT id, b, (coalesce(a, 0) * 0.5 + coalesce(b, 0) * 0.3 + c * 0.2) / (CASE WHEN a IS NULL THEN 0 ELSE 0.5::DOUBLE END + CASE WHEN b IS NULL THEN 0 ELSE 0.3::DOUBLE END + 0.2::DOUBLE) AS score FROM c)
SELECT id, round(CASE WHEN b >= 0.9 THEN greatest(score, 0.75) ELSE score END, 9) AS score FROM m""")
def composite_risk(spark: SparkSession, d: str) -> DataFrame:
    """The weighted mean of the available parts, floored where one is severe."""
    f = forecasts(spark, d)
    a, b, c = F.when(F.col("y") == 1, F.col("p") / 1000.0), F.when(F.col("toxic") == 1, F.lit(0.9)), F.pmod("id", F.lit(7)) / 7.0
    score = S.mean_of_available([(a, 0.5), (b, 0.3), (c, 0.2)])
    return f.select("id", F.round(F.when(b >= 0.9, F.greatest(score, F.lit(0.75))).otherwise(score), 9).alias("score"))
