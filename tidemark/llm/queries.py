"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_neighbours
from .bpe import round_trip
from .common import documents
from .decontamination import WINDOW_WORDS, contamination, contamination_report
from .divergence import LEAST_DOCUMENTS, PRIOR, TOP_TERMS, UNIT, divergence
from .exact_dedup import exact_dedup
from .near_dedup import near_dedup
from .packing import pack
from .ranked_search import TOP, search
from .secrets import IDENTIFIERS, SCOPE, SECRETS, STRONG, WEAK, scan_secrets
from .sharding import assign_shards
from .token_counts import attribute_tokens
from .token_files import read_token_files, token_folder, write_token_files
from .toxicity import fit_toxicity, score_toxicity


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_folder(spark)
    return read_token_files(write_token_files(documents(spark, sf_dir), folder), folder)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), percent=85)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir), 16)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_tokens(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_secrets, op3_bpe, op4_token_files, op5_near_dedup, op6_sharding, op7_token_counts, op8_exact_dedup, op9_toxicity, op10_neighbours, op11_divergence, op12_decontamination, op13_ranked_search)}


_EXACT = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""

_NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""


_DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT row) >= {LEAST_DOCUMENTS}),
v AS (SELECT l.lang, count(term) AS terms, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM g) l LEFT JOIN k USING (lang) GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST({UNIT} AS HUGEINT) * (coalesce(c.n, 0) + {PRIOR}) // (s.total + {PRIOR} * v.terms) AS p, 1 + CAST({UNIT} AS HUGEINT) * (k.n + {PRIOR}) // (v.total + {PRIOR} * v.terms) AS q
 FROM s JOIN v USING (lang) JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 4),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
 UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_CONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
n AS (SELECT DISTINCT item_id, least(len(w), {WINDOW_WORDS}) AS n, unnest(list_transform(range(1, greatest(len(w) - {WINDOW_WORDS} + 2, 2)), lambda x: array_to_string(w[x:x + {WINDOW_WORDS} - 1], ' '))) AS g FROM i WHERE len(w) > 0),
s AS (SELECT row, n, unnest(range(1, len(w) - n + 2)) AS b, unnest(list_transform(range(1, len(w) - n + 2), lambda x: array_to_string(w[x:x + n - 1], ' '))) AS g FROM d, (SELECT DISTINCT n FROM n)),
h AS (SELECT s.row, s.b, s.n, n.item_id FROM s JOIN n USING (n, g)),
c AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT row, unnest(range(b, b + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (row) LEFT JOIN t USING (row)
"""


_RANKED = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), x AS (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d),
s AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY 1, 2),
t AS (SELECT row, doc_id, n, term, count(*) AS tf FROM x SEMI JOIN i USING (term) GROUP BY 1, 2, 3, 4),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term, docs),
r AS (SELECT item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score FROM i JOIN t USING (term) JOIN f USING (term), s GROUP BY 1, 2, 3)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= {TOP}
"""


def _any_case(pattern: str) -> str:
    """A pattern with (?i:...) spelled out, as engines differ on what else folds to ASCII letters."""
    head, _, rest = pattern.partition("(?i:")
    inside, _, tail = rest.partition(")")
    return f"{head}(?:{re.sub('[a-z]', lambda m: f'[{m[0]}{m[0].upper()}]', inside)}){tail}" if rest else pattern


def _secrets_sql() -> str:
    kinds = (*STRONG, *WEAK)
    quoted = [_any_case(k.pattern).replace("'", "''") for k in kinds]
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS kind, unnest(m) AS found, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap, unnest(range(len(m))) AS pos FROM (SELECT doc_id, regexp_extract_all(t, '{q}', 0) AS m, string_split_regex(t, '{q}') AS g FROM d) x"
        for i, q in enumerate(quoted)
    )
    value = "CASE kind " + " ".join(f"WHEN {i} THEN " + (f"regexp_extract(found, '{q}', {k.value})" if k.value else "found") for i, (k, q) in enumerate(zip(kinds, quoted, strict=True))) + " END"
    least = "CASE kind " + " ".join(f"WHEN {i} THEN {k.least}" for i, k in enumerate(kinds)) + " END"
    names = "CASE kind " + " ".join(f"WHEN {i} THEN '{k.name}'" for i, k in enumerate(kinds)) + " END"
    key = [k.name for k in kinds].index("key")
    upto, on = "(PARTITION BY doc_id ORDER BY start RANGE UNBOUNDED PRECEDING)", "(PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    near = lambda names: f'coalesce(max("end") FILTER (WHERE name IN {names}) OVER {upto} >= start - {SCOPE}, false) OR coalesce(min(start) FILTER (WHERE name IN {names}) OVER {on} <= "end" + {SCOPE}, false)'
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
e AS (SELECT *, CAST(sum(gap + length(found)) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS BIGINT) AS "end", {value} AS value, {names} AS name FROM f),
s AS (SELECT doc_id, kind, name, "end" - length(found) AS start, "end" FROM e WHERE length(value) >= {least} AND (kind <> {key} OR (regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')))),
n AS (SELECT *, {near(IDENTIFIERS)} AS ids, {near(SECRETS)} AS keys FROM s),
k AS (SELECT *, name || ':' || start || ':' || "end" AS span FROM n WHERE kind < {len(STRONG)} OR CASE name WHEN 'id' THEN keys WHEN 'key' THEN ids ELSE ids AND keys END)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < {len(STRONG)}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN k USING (doc_id) GROUP BY 1
"""


def llm_oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express; the others are held against brute force in the tests."""
    return {"op2_secrets": _secrets_sql(), "op5_near_dedup": _NEAR, "op8_exact_dedup": _EXACT, "op11_divergence": _DIVERGENCE, "op12_decontamination": _CONTAMINATION, "op13_ranked_search": _RANKED}
