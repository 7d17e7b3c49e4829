"""Landed payloads of two shapes, made from the tables and read back as a venue's pages are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import stats
from ..operators import ranking
from ..sources import landing
from .registry import query, table

# Quotes of an order line, in SQL that both engines read alike: k is the order, n the line, s the supplier, q the quantity.
_BID, _ASK = "CASE WHEN q % 7 <> 0 THEN q + n END", "CASE WHEN k % 5 <> 0 THEN q + n + 1 + k % 4 END"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("int").alias("q"))


def _parsed(texts: DataFrame, schema: str) -> DataFrame:
    return texts.select(F.from_json("body", schema).alias("p")).select("p.*")


@query(f"""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS s, CAST(l_quantity AS INT) AS q FROM lineitem), f AS (SELECT k, n, s, q, {_BID} AS bid, {_ASK} AS ask FROM l)
SELECT 'M' || k || '-' || n AS ticker, CAST(bid AS INT) AS yes_bid, CAST(ask AS INT) AS yes_ask, CAST(ask - bid AS INT) AS spread, (ask + bid) / 200.0::DOUBLE AS midpoint, CAST(s AS BIGINT) AS liquidity, count(*) AS n FROM f GROUP BY 1, 2, 3, 4, 5, 6""")
def landed_markets(spark: SparkSession, d: str) -> DataFrame:
    """S3: pages of markets, one per order, half of them with whole cents and half with dollars as text, normalised to one form."""
    rows = _lines(spark, d).select("*", F.expr(_BID).alias("bid"), F.expr(_ASK).alias("ask"))
    dollars = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%d.%02d00", F.floor(F.col(c) / 100), F.col(c) % 100))
    old = F.col("k") % 2 == 0
    market = F.struct(F.concat_ws("-", F.concat(F.lit("M"), "k"), "n").alias("ticker"), F.when(old, F.coalesce("bid", F.lit(0))).alias("yes_bid"), F.when(old, F.coalesce("ask", F.lit(0))).alias("yes_ask"), F.when(~old, dollars("bid")).alias("yes_bid_dollars"), F.when(~old, dollars("ask")).alias("yes_ask_dollars"), F.col("s").alias("liquidity"))
    pages = rows.groupBy("k").agg(F.to_json(F.struct(F.lit("").alias("cursor"), F.collect_list(market).alias("markets"))).alias("body"))
    found = landing.markets(_parsed(pages, landing.MARKETS))
    return found.groupBy("ticker", "yes_bid", "yes_ask", "spread", "midpoint", "liquidity").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS s, CAST(l_quantity AS INT) AS q FROM lineitem),
v AS (SELECT k, CASE WHEN s % 2 = 0 THEN 'yes' ELSE 'no' END AS side, CASE WHEN k % 2 = 0 THEN (q + n * 3) * 100 ELSE (q + n * 3) * 100 + s % 100 END AS price, CASE WHEN n = 7 THEN -100 WHEN n = 5 THEN 0 ELSE CASE WHEN k % 2 = 0 THEN q * 100 ELSE q * 100 + 25 END END AS size FROM l),
f AS (SELECT *, size >= 0 AND price < 10000 AS valid FROM v),
b AS (SELECT k, max(price) FILTER (WHERE valid AND size > 0 AND side = 'yes') AS best_yes, max(price) FILTER (WHERE valid AND size > 0 AND side = 'no') AS best_no, coalesce(sum(size) FILTER (WHERE valid), 0) AS depth, count(*) FILTER (WHERE NOT valid) AS invalid FROM f GROUP BY 1)
SELECT 'M' || k AS ticker, CAST(best_yes AS BIGINT) AS best_yes, CAST(best_no AS BIGINT) AS best_no, CAST(10000 - best_no AS BIGINT) AS yes_ask, CAST(10000 - best_no - best_yes AS BIGINT) AS spread, CAST(depth AS BIGINT) AS depth, CAST(invalid AS BIGINT) AS invalid FROM b""")
def landed_books(spark: SparkSession, d: str) -> DataFrame:
    """A pull of order books, one page per order, in whole cents or in dollars as text; the tops and depths, and the levels that were no levels."""
    rows = _lines(spark, d)
    side = F.when(F.col("s") % 2 == 0, "yes").otherwise("no")
    price, size = F.col("q") + F.col("n") * 3, F.when(F.col("n") == 7, -1).when(F.col("n") == 5, 0).otherwise(F.col("q"))
    text = F.array(F.format_string("%d.%04d", F.floor((price * 100 + F.col("s") % 100) / 10_000), (price * 100 + F.col("s") % 100) % 10_000), F.when(F.col("n") == 7, "-1.00").when(F.col("n") == 5, "0.00").otherwise(F.format_string("%d.25", "q")))
    of = lambda name, level: F.collect_list(F.when(side == name, level))
    whole = F.array(price.cast("long"), size.cast("long"))
    by = rows.groupBy("k").agg(of("yes", whole).alias("y"), of("no", whole).alias("n"), of("yes", text).alias("yt"), of("no", text).alias("nt"))
    old = F.col("k") % 2 == 0
    body = F.struct(F.concat(F.lit("M"), "k").alias("ticker"), F.when(old, F.struct(F.col("y").alias("yes"), F.col("n").alias("no"))).alias("orderbook"), F.when(~old, F.struct(F.col("yt").alias("yes_dollars"), F.col("nt").alias("no_dollars"))).alias("orderbook_fp"))
    return landing.tops(landing.books(_parsed(by.select(F.to_json(body).alias("body")), landing.BOOK)))


_DOMAIN = "CASE s % 4 WHEN 0 THEN 'sports' WHEN 1 THEN 'macro' WHEN 2 THEN 'weather' END"


@query(f"""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS s, CAST(l_quantity AS INT) AS q FROM lineitem), f AS (SELECT coalesce({_DOMAIN}, 'unknown') AS domain, {_BID} AS bid, {_ASK} AS ask, n <> 5 AS booked FROM l),
v AS (SELECT *, CASE WHEN bid IS NOT NULL AND ask IS NOT NULL THEN ask - bid END AS spread FROM f),
r AS (SELECT domain, spread, row_number() OVER (PARTITION BY domain ORDER BY spread) AS place, count(spread) OVER (PARTITION BY domain) AS known FROM v),
p AS (SELECT domain, min(spread) FILTER (WHERE place >= ceil(0.5 * known)) AS p50, min(spread) FILTER (WHERE place >= ceil(0.9 * known)) AS p90, max(spread) AS worst FROM r WHERE spread IS NOT NULL GROUP BY 1)
SELECT domain, count(*) AS markets, count(spread) AS two_sided, count(spread)::DOUBLE / count(*) AS two_sided_rate, CAST(count(*) FILTER (WHERE booked) AS BIGINT) AS booked, count(*) FILTER (WHERE booked)::DOUBLE / count(*) AS book_rate, CAST(any_value(p50) AS INTEGER) AS p50, CAST(any_value(p90) AS INTEGER) AS p90, CAST(any_value(worst) AS INTEGER) AS worst,
CASE WHEN count(spread) < 12 THEN 'too_thin' WHEN count(spread)::DOUBLE / count(*) < 0.5 THEN 'one_sided' WHEN any_value(p50) <= 2 THEN 'tight' ELSE 'wide' END AS reading FROM v LEFT JOIN p USING (domain) GROUP BY 1""")
def venue_census(spark: SparkSession, d: str) -> DataFrame:
    """Per domain of a venue the markets, how many are quoted on both sides and have a book, and the spread's percentiles, from value counts."""
    rows = _lines(spark, d).select(F.coalesce(F.expr(_DOMAIN), F.lit("unknown")).alias("domain"), F.expr(_BID).alias("bid"), F.expr(_ASK).alias("ask"), (F.col("n") != 5).alias("booked")).withColumn("spread", F.col("ask") - F.col("bid"))
    n, two = F.count("*"), F.count("spread")
    by = rows.groupBy("domain").agg(n.alias("markets"), two.alias("two_sided"), stats.rate(two, n).alias("two_sided_rate"), stats.count_where(F.col("booked")).alias("booked"), stats.rate(stats.count_where(F.col("booked")), n).alias("book_rate"), F.max("spread").alias("worst"))
    counts = ranking.value_counts(rows.select("domain", "spread"), ["domain"], "spread", 1)
    at = ranking.at_ranks(counts, ["domain"], "spread", {"p50": ranking.nearest_rank(F.col("known"), 0.5, 1), "p90": ranking.nearest_rank(F.col("known"), 0.9, 1)})
    reading = L.first_reason([(F.col("two_sided") < 12, "too_thin"), (F.col("two_sided_rate") < 0.5, "one_sided"), (F.col("p50") <= 2, "tight")], "wide")
    out = by.join(at.select("domain", "p50", "p90"), "domain")
    return out.select("domain", "markets", "two_sided", "two_sided_rate", "booked", "book_rate", "p50", "p90", "worst", reading.alias("reading"))
