"""Landed JSON payloads of venues, normalised by schema; what a schema does not hold is kept apart.

Fetching is a job beside Spark that lands pages as files; these functions turn the landed pages into
tables, in batch or as a file stream, and never infer a schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKETS = "cursor string, markets array<struct<ticker string, title string, yes_bid int, yes_ask int, yes_bid_dollars string, yes_ask_dollars string, volume_24h long, liquidity long, open_interest long, close_time timestamp, rules_primary string>>"
CATALOG = "id string, question string, category string, outcomes string, outcomePrices string, bestBid double, bestAsk double, endDate timestamp"
PAIRS = "pairs array<struct<chainId string, pairAddress string, baseToken struct<address string, symbol string>, priceUsd string, liquidity struct<usd double>, volume struct<h1 double, h24 double>, fdv double, marketCap double>>"


def read_pages(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The pages that fit the schema, and the text of those that are no JSON."""
    text = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    corrupt = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_corrupt", T.StringType())])
    parsed = text.select("file", F.from_json("value", corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("p"))
    return parsed.where("p._corrupt IS NULL").select("file", "p.*").drop("_corrupt"), parsed.where("p._corrupt IS NOT NULL").select("file", F.col("p._corrupt").alias("text"))


def markets(pages: DataFrame) -> DataFrame:
    """One row per market; cents from whole numbers or from dollar text, whichever the payload has."""
    cents = lambda whole, dollars: F.coalesce(F.col(whole), F.round(F.col(dollars).cast("decimal(12,4)") * 100).cast("int"))
    m = pages.select(F.explode("markets").alias("m")).select("m.*")
    bid, ask = cents("yes_bid", "yes_bid_dollars"), cents("yes_ask", "yes_ask_dollars")
    zero = lambda c: F.when(c > 0, c)
    out = m.select("ticker", "title", zero(bid).alias("yes_bid"), zero(ask).alias("yes_ask"), "volume_24h", "liquidity", "open_interest", "close_time", "rules_primary")
    return out.withColumn("spread", F.col("yes_ask") - F.col("yes_bid")).withColumn("midpoint", (F.col("yes_ask") + F.col("yes_bid")) / 200)


def catalog(pages: DataFrame) -> DataFrame:
    """A second venue's markets; outcome lists come as JSON text."""
    texts = lambda c: F.from_json(c, "array<string>")
    return pages.select(F.col("id").alias("market_id"), "question", "category", texts("outcomes").alias("outcomes"), texts("outcomePrices").cast("array<double>").alias("outcome_prices"), F.col("bestBid").alias("best_bid"), F.col("bestAsk").alias("best_ask"), F.col("endDate").alias("end_date"))


def pairs(pages: DataFrame) -> DataFrame:
    p = pages.select(F.explode("pairs").alias("p")).select("p.*")
    return p.select(F.col("chainId").alias("chain"), F.col("baseToken.address").alias("token_address"), F.col("baseToken.symbol").alias("symbol"), F.col("pairAddress").alias("pair_address"), F.col("priceUsd").cast("double").alias("price_usd"), F.col("liquidity.usd").alias("liquidity_usd"), F.col("volume.h24").alias("volume_h24_usd"), F.col("fdv").alias("fdv"), F.col("marketCap").alias("market_cap"))


def stream_lines(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines as they land, by schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


#: A page of one market's book: whole cents and contracts, or dollars and contracts as text; a side may be left out.
BOOK = "ticker string, orderbook struct<yes array<array<long>>, no array<array<long>>>, orderbook_fp struct<yes_dollars array<array<string>>, no_dollars array<array<string>>>"


def books(pages: DataFrame) -> DataFrame:
    """One row per level of each page: ticker, side, price (hundredths of a cent), size (hundredths of a contract) and shape.

    A level that is no pair, has a part that is no number, a price outside (0, 1) dollars or a size below 0 keeps its row with nulls and
    ``valid`` false, as a level left out would look like none. A page without a book has no rows; a level of size 0 is valid and empty.
    """
    whole = lambda side: F.transform(F.col(f"orderbook.{side}"), lambda x: F.struct(F.lit(side).alias("side"), F.lit("cents").alias("shape"), F.when(F.size(x) == 2, F.get(x, F.lit(0)) * 100).alias("price"), F.when(F.size(x) == 2, F.get(x, F.lit(1)) * 100).alias("size")))
    number = lambda x, i, unit: F.when(F.size(x) == 2, F.round(F.get(x, F.lit(i)).try_cast("decimal(18,6)") * unit).cast("long"))
    text = lambda side: F.transform(F.col(f"orderbook_fp.{side}_dollars"), lambda x: F.struct(F.lit(side).alias("side"), F.lit("dollars").alias("shape"), number(x, 0, 10_000).alias("price"), number(x, 1, 100).alias("size")))
    none = F.array().cast("array<struct<side: string, shape: string, price: long, size: long>>")
    levels = F.concat(*[F.coalesce(f(side), none) for f in (whole, text) for side in ("yes", "no")])
    rows = pages.select("ticker", F.explode(levels).alias("x")).select("ticker", "x.*")
    fit = F.coalesce((F.col("price") > 0) & (F.col("price") < 10_000) & (F.col("size") >= 0), F.lit(False))
    return rows.select("ticker", "side", "shape", F.when(fit, F.col("price")).alias("price"), F.when(fit, F.col("size")).alias("size"), fit.alias("valid"))


def tops(levels: DataFrame) -> DataFrame:
    """Per ticker: best_yes, best_no, yes_ask (the complement of best_no), spread, depth and how many levels were not valid; of empty levels none is a best one."""
    full = F.col("size") > 0
    best = lambda side: F.max(F.when(full & (F.col("side") == side), F.col("price")))
    by = levels.groupBy("ticker").agg(best("yes").alias("best_yes"), best("no").alias("best_no"), F.coalesce(F.sum("size"), F.lit(0)).alias("depth"), F.count(F.when(~F.col("valid"), 1)).alias("invalid"))
    ask = 10_000 - F.col("best_no")
    return by.select("ticker", "best_yes", "best_no", ask.alias("yes_ask"), (ask - F.col("best_yes")).alias("spread"), "depth", "invalid")
