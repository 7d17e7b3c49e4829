"""Domains and kinds of markets, from their tickers and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Domains in order, with the beginnings of their tickers and their words.
DOMAINS = (
    ("sports_baseball", ("KXMLB",), ("mlb", "baseball", "pitcher", "home run", "rbis", "innings")),
    ("sports_tennis", ("KXATP", "KXWTA", "KXITF"), ("tennis", "atp", "wta", "itf", "grand slam", "wimbledon")),
    ("sports_soccer", ("KXWC", "KXUCL", "KXEPL", "KXMLS"), ("soccer", "fifa", "uefa", "world cup", "premier league", "goals scored")),
    ("macro", ("KXFED", "KXCPI", "KXGDP", "KXPAYROLL"), ("federal funds", "fed ", "cpi", "inflation", "gdp", "unemployment", "payroll", "interest rate", "economics")),
    ("weather", ("KXHIGH", "KXRAIN", "KXSNOW", "KXHURRICANE"), ("temperature", "rainfall", "snowfall", "hurricane", "weather", "noaa", "climate")),
    ("politics", ("KXPRES", "KXSENATE", "KXHOUSE", "KXGOV"), ("election", "president", "senate", "congress", "governor", "politics", "nominee")),
    ("crypto", ("KXBTC", "KXETH", "KXCRYPTO"), ("bitcoin", "btc", "ethereum", "eth", "crypto", "solana")),
)
GENERAL = "general"
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
GAME_TICKER = r"^KXMLB[A-Z0-9]*-(\d{2})([A-Z]{3})(\d{2})\d{4}([A-Z]{4,6})(?:-|$)"


def domain(ticker: Column, words: Column) -> Column:
    """The first domain whose tickers begin so; if there is none, the first one of whose words any occurs; else general."""
    upper, lower = F.upper(F.coalesce(ticker, F.lit(""))), F.lower(F.coalesce(words, F.lit("")))
    out = F.when(F.lit(False), "")
    for name, prefixes, _ in DOMAINS:
        out = out.when(upper.rlike("^(" + "|".join(prefixes) + ")"), name)
    for name, _, terms in DOMAINS:
        out = out.when(lower.rlike("|".join(terms)), name)
    return out.otherwise(GENERAL)


def with_game_spec(rows: DataFrame, ticker: str) -> DataFrame:
    """``rows`` with kind (total, spread, winner or unknown), threshold, team and home of a baseball market's ticker.

    A line lies half below the number. A team is known by the end of the matchup that it is at; one that
    is at both ends, or at neither, leaves the market unknown. Steps are columns of their own, so that
    each is computed once.
    """
    upper, spread = F.upper(ticker), r"^([A-Z]{2,3})(\d+)$"
    rows = rows.withColumns({"_series": F.split(upper, "-")[0], "_suffix": F.element_at(F.split(upper, "-"), -1), "_month": F.regexp_extract(upper, GAME_TICKER, 2), "_teams": F.regexp_extract(upper, GAME_TICKER, 4)})
    series, suffix = F.col("_series"), F.col("_suffix")
    team = F.when(series == "KXMLBSPREAD", F.regexp_extract(suffix, spread, 1)).when(series == "KXMLBGAME", F.regexp_extract(suffix, "^[A-Z]+$", 0)).otherwise("")
    number = F.when(series == "KXMLBSPREAD", F.regexp_extract(suffix, spread, 2)).when(series == "KXMLBTOTAL", F.regexp_extract(suffix, r"^\d+$", 0)).otherwise("")
    rows = rows.withColumns({"_team": F.nullif(team, F.lit("")), "_number": F.nullif(number, F.lit("")), "_matchup": F.when(F.col("_month").isin(*MONTHS), F.col("_teams"))})
    rows = rows.withColumns({"_first": F.col("_matchup").startswith(F.col("_team")), "_last": F.col("_matchup").endswith(F.col("_team"))})
    rows = rows.withColumn("_home", F.when(F.col("_first") != F.col("_last"), F.col("_last")))
    total, sided = (series == "KXMLBTOTAL") & F.col("_number").isNotNull(), F.col("_home").isNotNull()
    rows = rows.withColumn("kind", F.when(total, "total").when(sided & (series == "KXMLBSPREAD"), "spread").when(sided, "winner").otherwise("unknown"))
    rows = rows.withColumns({"threshold": F.when(F.col("kind") != "unknown", F.col("_number").cast("double") - 0.5), "team": F.when(sided, F.col("_team")), "home": F.col("_home")})
    return rows.drop("_series", "_suffix", "_month", "_teams", "_team", "_number", "_matchup", "_first", "_last", "_home")


# The shape of football and tennis tickers; a time may stand between day and matchup.
MATCH_TICKER = r"^(?:{0})([A-Z0-9]*)-(\d{{2}})([A-Z]{{3}})(\d{{2}})(?:\d{{4}})?([A-Z]{{4,{1}}})(?:-(.+))?$"
SOCCER_TICKER = MATCH_TICKER.format("KXWC|KXUCL|KXEPL|KXMLS", 8)
TENNIS_TICKER = MATCH_TICKER.format("KXATP|KXWTA|KXITF", 12)
TENNIS_WINNERS = "MATCH|WINNER|WIN|GAME"


def _with_parts(rows: DataFrame, ticker: str, pattern: str) -> DataFrame:
    """``rows`` with the ticker's series after its venue's letters, its matchup where the month is one, and what follows the last dash."""
    upper = F.upper(F.coalesce(ticker, F.lit("")))
    rows = rows.withColumns({"_upper": upper, "_month": F.regexp_extract(upper, pattern, 3), "_suffix": F.element_at(F.split(upper, "-"), -1)})
    fits = F.col("_month").isin(*MONTHS)
    rows = rows.withColumns({"_series": F.when(fits, F.regexp_extract("_upper", pattern, 1)), "_full": F.split("_upper", "-")[0], "_matchup": F.when(fits, F.regexp_extract("_upper", pattern, 5)), "_tail": F.when(fits, F.regexp_extract("_upper", pattern, 6))})
    even, half = F.length("_matchup") % 2 == 0, F.length("_matchup") / 2
    return rows.withColumns({"_a": F.when(even, F.substring(F.col("_matchup"), F.lit(1), half.cast("int"))), "_b": F.when(even, F.substring(F.col("_matchup"), (half + 1).cast("int"), half.cast("int")))})


_PARTS = ("_upper", "_month", "_suffix", "_series", "_full", "_matchup", "_tail", "_a", "_b")


def with_soccer_spec(rows: DataFrame, ticker: str) -> DataFrame:
    """``rows`` with kind (total, advance, spread, player_goal, winner or unknown), threshold, team and second_listed of a football market's ticker.

    A matchup of even length is two codes, and only such tell a team. A whole line lies half below its number, one with a
    fraction is itself; a player's goal can't be priced from a match and says so. What doesn't fit is unknown.
    """
    rows, series = _with_parts(rows, ticker, SOCCER_TICKER), F.col("_full")
    known = F.col("_series").isNotNull()
    line = F.regexp_extract("_tail", r"^[TB]*(\d+(?:\.\d+)?)$", 1).try_cast("double")
    is_total, is_advance = series.endswith("TOTAL"), series.contains("ADVANCE")
    is_spread, is_goal = series.rlike("SPREAD|HANDICAP"), series.contains("GOAL")
    letters, margin = F.regexp_extract("_suffix", "^[A-Z]+$", 0), r"^([A-Z]{2,4})(\d+)$"
    code = F.when(is_total, None).when(is_spread & ~is_advance, F.regexp_extract("_suffix", margin, 1)).when(is_advance | (~is_goal & series.rlike("GAME|MATCH|WIN")), letters)
    second = F.when(F.col("_a") == F.col("_code"), F.lit(False)).when(F.col("_b") == F.col("_code"), F.lit(True))
    rows = rows.withColumn("_code", F.when(known, code)).withColumn("_second", second)
    sided = F.col("_second").isNotNull()
    kind = (
        F.when(~known, "unknown").when(is_total, F.when(line.isNotNull(), "total").otherwise("unknown")).when(is_advance, F.when(sided, "advance").otherwise("unknown"))
        .when(is_spread, F.when(sided, "spread").otherwise("unknown")).when(is_goal, "player_goal").when(sided, "winner").otherwise("unknown")
    )
    half_below = F.when(line == F.floor(line), line - 0.5).otherwise(line)
    threshold = F.when(F.col("kind") == "total", half_below).when(F.col("kind") == "spread", F.regexp_extract("_suffix", margin, 2).try_cast("double") - 0.5)
    told = F.col("kind").isin("advance", "spread", "winner")
    return rows.withColumn("kind", kind).withColumns({"threshold": threshold, "team": F.when(told, F.col("_code")), "second_listed": F.when(told, F.col("_second"))}).drop("_code", "_second", *_PARTS)


def with_tennis_spec(rows: DataFrame, ticker: str) -> DataFrame:
    """``rows`` with kind (winner or unknown), player and first_listed of a tennis market's ticker.

    Codes of unlike lengths are told by the end of the matchup that they stand at; one at both ends, or at neither, leaves it unknown.
    """
    rows = _with_parts(rows, ticker, TENNIS_TICKER)
    code = F.nullif(F.regexp_extract("_suffix", "^[A-Z]+$", 0), F.lit(""))
    rows = rows.withColumn("_code", F.when(F.col("_series").rlike(TENNIS_WINNERS), code))
    starts, ends = F.col("_matchup").startswith(F.col("_code")), F.col("_matchup").endswith(F.col("_code"))
    first = F.when(F.col("_a") == F.col("_code"), F.lit(True)).when(F.col("_b") == F.col("_code"), F.lit(False)).when(starts != ends, starts)
    rows = rows.withColumn("first_listed", first)
    told = F.col("first_listed").isNotNull()
    return rows.withColumns({"kind": F.when(told, "winner").otherwise("unknown"), "player": F.when(told, F.col("_code"))}).drop("_code", *_PARTS)
