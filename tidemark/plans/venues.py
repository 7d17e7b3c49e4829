"""Markets by domain and kind, and the scores of cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policies as P
from ..functions import text
from ..functions import venues as V
from ..operators import calibration as C
from .forecasting import _BIN
from .registry import FORECASTS, forecasts, query, table

_TICKER = "CASE doc_id % 11 WHEN 0 THEN 'KXMLBGAME-26JUL082210COLLAD-COL' WHEN 1 THEN 'kxatpmatch-26JUL09' WHEN 2 THEN 'KXFED' WHEN 3 THEN 'KXHURRICANE-A-B-C' WHEN 4 THEN 'KXBTCD-1' WHEN 5 THEN '' WHEN 6 THEN 'XKXMLB-2' ELSE 'OTHER-' || doc_id END"
_WORDS = "concat(text, CASE doc_id % 8 WHEN 0 THEN ' Bitcoin' WHEN 1 THEN ' the Premier League' WHEN 2 THEN ' inflation and election' WHEN 3 THEN ' the World Cup' WHEN 4 THEN ' a governor' ELSE '' END)"
_FITS = " ".join(f"WHEN {' OR '.join(f'starts_with(upper(ticker), {p!r})' for p in prefixes)} THEN '{name}'" for name, prefixes, _ in V.DOMAINS)
_SAYS = " ".join(f"WHEN {' OR '.join(f'contains(lower(words), {w!r})' for w in words)} THEN '{name}'" for name, _, words in V.DOMAINS)


@query(f"""WITH d AS (SELECT doc_id, {_TICKER} AS ticker, {_WORDS} AS words FROM documents)
SELECT doc_id, CASE {_FITS} {_SAYS} ELSE 'general' END AS domain, split_part(ticker, '-', 1) AS series, CASE WHEN contains(ticker, '-') THEN split_part(ticker, '-', 2) ELSE ticker END AS game FROM d""")
def market_domains(spark: SparkSession, d: str) -> DataFrame:
    """A market's domain by the beginning of its ticker, then by its words; its series and its game."""
    rows = table(spark, d, "documents").select("doc_id", F.expr(_TICKER).alias("ticker"), F.expr(_WORDS).alias("words"))
    ticker = F.col("ticker")
    return rows.select("doc_id", V.domain(ticker, F.col("words")).alias("domain"), text.series_of(ticker).alias("series"), P.game_of(ticker).alias("game"))


_TEAMS = "CASE {0} WHEN 0 THEN 'COL' WHEN 1 THEN 'LAD' WHEN 2 THEN 'NY' WHEN 3 THEN 'SD' ELSE 'BOS' END"
_A, _B, _C = _TEAMS.format("p_partkey % 5"), _TEAMS.format("p_size % 5"), _TEAMS.format("p_partkey % 3")
_SERIES = "CASE p_partkey % 7 WHEN 0 THEN 'KXMLBTOTAL' WHEN 1 THEN 'KXMLBSPREAD' WHEN 2 THEN 'KXMLBGAME' WHEN 3 THEN 'KXMLBF' WHEN 4 THEN 'KXMLBSPREAD' WHEN 5 THEN 'KXMLBGAME' ELSE 'KXMLBTOTAL' END"
_SUFFIX = f"CASE p_partkey % 7 WHEN 1 THEN concat({_C}, '', p_size % 4) WHEN 4 THEN 'X' WHEN 6 THEN 'O9' WHEN 0 THEN concat('', p_size) ELSE {_C} END"
_GAME = f"concat({_SERIES}, CASE WHEN p_partkey % 13 = 0 THEN '-26XXX082210' ELSE '-26JUL082210' END, {_A}, {_B}, '-', {_SUFFIX})"


@query(f"""WITH t AS (SELECT p_partkey, {_GAME} AS ticker, {_SERIES} AS series, {_SUFFIX} AS suffix, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE {_A} || {_B} END AS matchup FROM part),
s AS (SELECT *, CASE series WHEN 'KXMLBSPREAD' THEN regexp_extract(suffix, '^([A-Z]+)[0-9]+$', 1) WHEN 'KXMLBGAME' THEN suffix ELSE '' END AS team FROM t),
h AS (SELECT *, CASE WHEN team = '' OR (starts_with(matchup, team) AND ends_with(matchup, team)) THEN NULL WHEN starts_with(matchup, team) THEN false WHEN ends_with(matchup, team) THEN true END AS home FROM s),
k AS (SELECT *, CASE WHEN series = 'KXMLBTOTAL' AND regexp_full_match(suffix, '[0-9]+') THEN 'total' WHEN home IS NULL THEN 'unknown' WHEN series = 'KXMLBSPREAD' THEN 'spread' ELSE 'winner' END AS kind FROM h)
SELECT p_partkey, kind, CASE WHEN kind IN ('total', 'spread') THEN CAST(regexp_extract(suffix, '([0-9]+)$', 1) AS DOUBLE) - 0.5 END AS threshold, CASE WHEN kind IN ('spread', 'winner') THEN team END AS team, CASE WHEN kind IN ('spread', 'winner') THEN home END AS home FROM k""")
def game_specs(spark: SparkSession, d: str) -> DataFrame:
    """Of G3 the grammar of baseball: kind, line, team and side of a market from its ticker; what is not certain is unknown."""
    return V.with_game_spec(table(spark, d, "part").select("p_partkey", F.expr(_GAME).alias("ticker")), "ticker").drop("ticker")


_CODES = "CASE {0} WHEN 0 THEN 'USA' WHEN 1 THEN 'WAL' WHEN 2 THEN 'BRA' ELSE 'ENGL' END"
_SA, _SB, _SC = _CODES.format("p_partkey % 4"), _CODES.format("p_size % 4"), _CODES.format("p_partkey % 3")
_KINDS = "CASE p_partkey % 9 WHEN 0 THEN 'KXWCTOTAL' WHEN 1 THEN 'KXUCLADVANCE' WHEN 2 THEN 'KXEPLSPREAD' WHEN 3 THEN 'KXMLSGOALSCORER' WHEN 4 THEN 'KXWCGAME' WHEN 5 THEN 'KXWCFOO' WHEN 6 THEN 'KXWCTOTAL' WHEN 7 THEN 'KXEPLHANDICAP' ELSE 'KXNBAGAME' END"
_TAIL = f"CASE p_partkey % 9 WHEN 0 THEN concat('T', p_size % 5, '.5') WHEN 6 THEN concat('', p_size % 5) WHEN 2 THEN concat({_SC}, p_size % 4) WHEN 7 THEN concat('X', p_size) ELSE {_SC} END"
_MATCH = f"concat({_KINDS}, CASE WHEN p_partkey % 17 = 0 THEN '-26XXX14' WHEN p_size % 2 = 0 THEN '-26JUN141800' ELSE '-26JUN14' END, {_SA}, {_SB}, '-', {_TAIL})"


@query(f"""WITH t AS (SELECT p_partkey, {_KINDS} AS series, {_TAIL} AS tail, {_SA} AS a, {_SB} AS b, p_partkey % 17 <> 0 AS dated FROM part),
c AS (SELECT *, dated AND series NOT LIKE 'KXNBA%' AS known, length(a) = length(b) AS even, CASE WHEN series LIKE '%SPREAD' OR series LIKE '%HANDICAP' THEN regexp_extract(tail, '^([A-Z]{{2,4}})([0-9]+)$', 1) ELSE regexp_extract(tail, '^[A-Z]+$') END AS code FROM t),
d AS (SELECT *, CASE WHEN even AND code = a THEN false WHEN even AND code = b THEN true END AS second, TRY_CAST(regexp_extract(tail, '^[TB]*([0-9]+(\\.[0-9]+)?)$', 1) AS DOUBLE) AS line FROM c),
k AS (SELECT *, CASE WHEN NOT known THEN 'unknown' WHEN series LIKE '%TOTAL' THEN CASE WHEN line IS NOT NULL THEN 'total' ELSE 'unknown' END WHEN series LIKE '%GOAL%' THEN 'player_goal' WHEN second IS NULL OR series LIKE '%FOO' THEN 'unknown' WHEN series LIKE '%ADVANCE' THEN 'advance' WHEN series LIKE '%GAME' THEN 'winner' ELSE 'spread' END AS kind FROM d)
SELECT p_partkey, kind, CASE kind WHEN 'total' THEN CASE WHEN line = floor(line) THEN line - 0.5 ELSE line END WHEN 'spread' THEN CAST(regexp_extract(tail, '([0-9]+)$', 1) AS DOUBLE) - 0.5 END AS threshold, CASE WHEN kind IN ('spread', 'winner', 'advance') THEN code END AS team, CASE WHEN kind IN ('spread', 'winner', 'advance') THEN second END AS second_listed FROM k""")
def soccer_specs(spark: SparkSession, d: str) -> DataFrame:
    """Of G3 the grammar of football: totals, advances, spreads, winners and players' goals."""
    return V.with_soccer_spec(table(spark, d, "part").select("p_partkey", F.expr(_MATCH).alias("ticker")), "ticker").drop("ticker")


_RIVALS = "CASE {0} WHEN 0 THEN 'DJOK' WHEN 1 THEN 'ALC' WHEN 2 THEN 'SWI' WHEN 3 THEN 'DJO' ELSE 'GAU' END"
_RA, _RB, _RC = _RIVALS.format("p_partkey % 5"), _RIVALS.format("p_size % 5"), _RIVALS.format("p_size % 3")
_TENNIS = "CASE p_partkey % 4 WHEN 0 THEN 'KXATPMATCH' WHEN 1 THEN 'kxwtawinner' WHEN 2 THEN 'KXITFSET' ELSE 'KXATPGAME' END"


@query(f"""WITH t AS (SELECT p_partkey, {_TENNIS} AS series, {_RA} AS a, {_RB} AS b, {_RC} AS c, p_partkey % 7 <> 0 AS dated FROM part), m AS (SELECT *, a || b AS m FROM t),
h AS (SELECT *, CASE WHEN length(m) % 2 = 0 THEN m[1:length(m) // 2] END AS x, CASE WHEN length(m) % 2 = 0 THEN m[length(m) // 2 + 1:] END AS y FROM m),
f AS (SELECT *, CASE WHEN NOT dated OR series LIKE '%SET' THEN NULL WHEN x = c THEN true WHEN y = c THEN false WHEN starts_with(m, c) <> ends_with(m, c) THEN starts_with(m, c) END AS first_listed FROM h)
SELECT p_partkey, CASE WHEN first_listed IS NULL THEN 'unknown' ELSE 'winner' END AS kind, CASE WHEN first_listed IS NOT NULL THEN c END AS player, first_listed FROM f""")
def tennis_specs(spark: SparkSession, d: str) -> DataFrame:
    """Of G3 the grammar of tennis: winners only, the player told by half or end of the matchup."""
    ticker = F.expr(f"concat({_TENNIS}, CASE WHEN p_partkey % 7 = 0 THEN '-26MAX25' ELSE '-26MAY25' END, {_RA}, {_RB}, '-', {_RC})")
    return V.with_tennis_spec(table(spark, d, "part").select("p_partkey", ticker.alias("ticker")), "ticker").drop("ticker")


@query(f"""WITH {FORECASTS}, b AS (SELECT source, {_BIN} AS bin, count(*) AS n, sum(p) AS sum_p, sum(y) AS yes, sum((p - 1000 * y) * (p - 1000 * y)) AS sq FROM forecasts GROUP BY 1, 2), t AS (SELECT source, sum(n) AS total, sum(yes)::DOUBLE / sum(n) AS base FROM b GROUP BY 1),
c AS (SELECT source, CAST(sum(n) AS BIGINT) AS n, max(base) AS prevalence, sum(sq)::DOUBLE / 1000000 / sum(n) AS brier, sum(abs(sum_p / 1000.0::DOUBLE - yes)) / sum(n) AS ece, coalesce(max(abs(sum_p / 1000.0::DOUBLE - yes) / n) FILTER (WHERE n >= 10), max(abs(sum_p / 1000.0::DOUBLE - yes) / n)) AS mce, count(*) AS populated_bins,
sum(n * (sum_p / 1000.0::DOUBLE / n - yes::DOUBLE / n) ** 2) / sum(n) AS reliability, sum(n * (yes::DOUBLE / n - base) ** 2) / sum(n) AS resolution FROM b JOIN t USING (source) GROUP BY 1)
SELECT source, n, round(prevalence, 6) AS prevalence, round(brier, 6) AS brier, 0.25::DOUBLE AS neutral_brier, round(prevalence * (1 - prevalence), 6) AS base_brier, round(CASE WHEN prevalence * (1 - prevalence) > 0 THEN 1 - brier / (prevalence * (1 - prevalence)) END, 6) AS skill, round(ece, 6) AS ece, round(mce, 6) AS mce, populated_bins,
round(reliability, 6) AS reliability, round(resolution, 6) AS resolution, round(n::DOUBLE / sum(n) OVER (), 4) AS share, CASE WHEN n >= {C.LEAST_COHORT} THEN 'measured' ELSE 'too_thin' END AS label FROM c ORDER BY n DESC, source LIMIT 10""")
def cohort_scores(spark: SparkSession, d: str) -> DataFrame:
    """Errors, scores, decomposition and share of each source's forecasts, the ten largest sources first; all from one table of bins."""
    return C.cohorts(C.bins(forecasts(spark, d), ["source"]), "source", 10)
