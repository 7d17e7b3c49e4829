"""Title normalisation, token sets, domains and content identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that don't tell titles apart.
STOP_WORDS = (
    "will", "the", "a", "an", "to", "at", "on", "in", "of", "for", "be", "by", "and", "or", "is", "are",
    "this", "that", "who", "what", "which", "market", "vs", "versus", "v",
)


def normalised_title(text: Column) -> Column:
    """Lower case, forms of 'versus' as vs, other than a-z and 0-9 as single spaces, trimmed; null gives ''."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\bvs?\.?\b|\bversus\b", " vs ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9 ]+", " "), " +", " "))


def title_tokens(text: Column) -> Column:
    """The distinct words of a normalised title without stop words."""
    words = F.array_distinct(F.split(normalised_title(text), " "))
    return F.array_except(words, F.array(*[F.lit(w) for w in ("", *STOP_WORDS)]))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def content_identity(text: Column) -> Column:
    """SHA-256 of the text with each run of white space as one space, trimmed, in lower case."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\v]+", " "))), 256)


def series_of(ticker: Column) -> Column:
    return F.split(ticker, "-")[0]


def by_prefix(value: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first prefix that fits."""
    out = F.when(value.startswith(rules[0][0]), rules[0][1])
    for prefix, label in rules[1:]:
        out = out.when(value.startswith(prefix), label)
    return out.otherwise(otherwise)


def tag_value(tags: Column, prefix: str, default: str = "unknown") -> Column:
    """What follows the first ':' of the first tag with the prefix."""
    found = F.filter(tags, lambda t: t.startswith(prefix))
    return F.when(F.size(found) > 0, F.regexp_replace(F.get(found, 0), "^[^:]*:", "")).otherwise(default)


def text_clarity(text: Column, subjective: list[str], several: list[str], source: str, least_length: int = 40) -> Column:
    """1 less penalties: 0.15 per subjective term (at most 0.45), 0.25 without a source, 0.20 each for several conditions and brevity; in hundredths, never below 0."""
    lowered = F.lower(text)
    terms = sum((F.when(lowered.rlike(rf"\b{w}\b"), 1).otherwise(0) for w in subjective), F.lit(0))
    many = lowered.rlike("|".join(several)) | (F.size(F.split(lowered, " and ")) > 3)
    points = F.lit(100) - F.least(F.lit(45), terms * 15) - F.when(lowered.rlike(source), 0).otherwise(25) - F.when(many, 20).otherwise(0) - F.when(F.length(text) < least_length, 20).otherwise(0)
    return F.when(F.length(F.trim(text)) > 0, F.greatest(points, F.lit(0))).otherwise(F.lit(0))


# Fixed values of the clarity of rules: vague terms, ways to name a source, signs of several conditions, penalties in hundredths and steps of the reading.
SUBJECTIVE_TERMS = (
    "significant", "significantly", "major", "substantial", "substantially", "expected", "likely", "unlikely", "widely", "generally", "considered", "roughly", "serious", "notable",
)
SOURCE_PATTERNS = (
    r"according to ([^.;\n]{3,100})", r"as (?:published|reported|announced|determined|listed|posted) by ([^.;\n]{3,100})", r"\b(official [a-z][a-z0-9 ,'/-]{2,80})",
    r"\b((?:https?://)?(?:[\w-]+\.)+(?:gov|com|org|net|edu)(?:/\S*)?)",
)
MULTI_CONDITION_MARKERS = ("all of the following", "each of the following", "both of the following", "in combination")
EACH_TERM, MOST_OF_TERMS, NO_SOURCE, SEVERAL, TOO_SHORT, LEAST_LENGTH = 15, 45, 25, 20, 20, 40
LOW_RISK, MEDIUM_RISK, RESEARCHABLE, AVOID = 80, 55, 70, 40


def settlement_source(rules: Column) -> Column:
    """What the first way of naming a source that is found names; null where none is."""
    found = [F.nullif(F.trim(F.regexp_extract(rules, f"(?i){p}", 1)), F.lit("")) for p in SOURCE_PATTERNS]
    return F.coalesce(*found)


def with_clarity(rows: DataFrame, title: str, rules: str, source: str | None = None, researchable: int = RESEARCHABLE) -> DataFrame:
    """``rows`` with points (hundredths), risk, tradeability, settlement_source and flags of how clear the rules of a market are.

    A known ``source`` goes before what the text names. Three or more times " and ", or a sign of it, makes several conditions. Missing
    or blank rules have no points, an unknown risk and one flag.
    """
    text = F.trim(F.regexp_replace(F.coalesce(rules, F.lit("")), r"^[\s]+|[\s]+$", ""))
    rows = rows.withColumn("_rules", text)
    both = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), "_rules"))
    terms = F.filter(F.array(*[F.when(both.rlike(rf"\b{t}\b"), t) for t in sorted(SUBJECTIVE_TERMS)]), lambda x: x.isNotNull())
    lowered = F.lower("_rules")
    several = lowered.rlike("|".join(MULTI_CONDITION_MARKERS)) | (F.size(F.split(lowered, " and ")) > 3)
    named = F.coalesce(F.col(source), settlement_source(F.col("_rules"))) if source else settlement_source(F.col("_rules"))
    rows = rows.withColumns({"_terms": terms, "settlement_source": F.when(F.col("_rules") != "", named), "_several": several})
    short, none, blank = F.length("_rules") < LEAST_LENGTH, F.col("settlement_source").isNull(), F.col("_rules") == ""
    points = 100 - F.least(F.lit(MOST_OF_TERMS), F.size("_terms") * EACH_TERM) - F.when(none, NO_SOURCE).otherwise(0) - F.when(F.col("_several"), SEVERAL).otherwise(0) - F.when(short, TOO_SHORT).otherwise(0)
    rows = rows.withColumn("points", F.when(blank, 0).otherwise(F.greatest(points, F.lit(0))))
    flag = lambda c, name: F.when(c, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    flags = F.concat(F.transform("_terms", lambda t: F.concat(F.lit("subjective_wording:"), t)), flag(none, "unclear_settlement_source"), flag(F.col("_several"), "multi_condition_phrasing"), flag(short, "rules_text_too_short"))
    p = F.col("points")
    risk = F.when(blank, "unknown").when(p >= LOW_RISK, "low").when(p >= MEDIUM_RISK, "medium").otherwise("high")
    use = F.when(blank, "needs_manual_review").when(p >= researchable, "researchable").when(p >= AVOID, "needs_manual_review").otherwise("avoid")
    return rows.withColumns({"risk": risk, "tradeability": use, "flags": F.when(blank, F.array(F.lit("missing_rules_text"))).otherwise(flags)}).drop("_rules", "_terms", "_several")
