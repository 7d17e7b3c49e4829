"""Joins, set operations, text matching, deduplication, sequences, predicates, retention and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import codec, labels as L, stats, text
from ..operators import asof, buckets, dedupe, predicates, ranking, retention, selection, sequences, similarity
from ..session import partitions
from .registry import TICKS, micros, query, table, ticks


@query("SELECT n_name, count(*) AS customers, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' GROUP BY 1")
def star_join(spark: SparkSession, d: str) -> DataFrame:
    """Small sides by equi-joins; the planner picks the strategy from their sizes."""
    places = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    rows = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("customers"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))


@query("SELECT doc_id, lang, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'not_final' END AS state FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality = 0")
def backlog_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose result is missing or not final."""
    known = table(spark, d, "labels").select("doc_id", "quality")
    rows = table(spark, d, "documents").select("doc_id", "lang").join(known, "doc_id", "left").where("quality IS NULL OR quality = 0")
    return rows.select("doc_id", "lang", F.when(F.col("quality").isNull(), "missing").otherwise("not_final").alias("state"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A lookup by ids as a semi join."""
    large = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(large, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a partner; not written as NOT IN, whose nulls mean something else."""
    open_ = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(open_, "c_custkey", "left_anti")


@query("SELECT o_custkey, min(o_orderdate) AS first_at, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first_price FROM orders GROUP BY 1")
def first_value_join(spark: SparkSession, d: str) -> DataFrame:
    """The first row's value per key, without joining back."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_at"), F.min_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("first_price"))


@query(f"""WITH {TICKS}, e AS (SELECT max(t) AS now FROM ticks), k AS (SELECT key, min(t) AS born, arg_min(cents, (t, id)) AS first_cents, max(t) AS last_seen FROM ticks GROUP BY 1)
SELECT key, CASE WHEN now - born > 29 * 86400000000 AND now - last_seen > 86400000000 THEN 'retention_lost' WHEN first_cents < 300 THEN 'missing_initial_state' WHEN now - born < 86400000000 THEN 'not_yet_due' WHEN now - last_seen <= 86400000000 THEN 'recoverable' ELSE 'other' END AS state FROM k, e""")
def backlog_classification(spark: SparkSession, d: str) -> DataFrame:
    """Of J20 the ordered ladder, over conditions on a key's age and first value that stand in for those of J18 and J19."""
    t, day = ticks(spark, d), 86_400_000_000
    k = t.groupBy("key").agg(F.min("t").alias("born"), F.min_by("cents", F.struct("t", "id")).alias("first_cents"), F.max("t").alias("last_seen"))
    now = t.agg(F.max("t").alias("now"))
    old, seen = F.col("now") - F.col("born"), F.col("now") - F.col("last_seen")
    state = L.first_reason([((old > 29 * day) & (seen > day), "retention_lost"), (F.col("first_cents") < 300, "missing_initial_state"), (old < day, "not_yet_due"), (seen <= day, "recoverable")], "other")
    return k.join(F.broadcast(now)).select("key", state.alias("state"))


@query("""WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate, c_nationkey, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0)
SELECT o_orderkey, CASE WHEN c_nationkey IS NULL THEN 'no_counterpart' WHEN c_nationkey >= 20 THEN 'wrong_scope' WHEN o_orderdate < TIMESTAMP '1993-01-01' THEN 'too_early' ELSE 'joined' END AS verdict FROM s""")
def gated_join(spark: SparkSession, d: str) -> DataFrame:
    """J13, of J14 the gates: evidence joined by identifier only, refusals named, the cheapest gate first."""
    evidence = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(evidence, "o_custkey", "left")
    early = F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ'1993-01-01 00:00:00'")
    return rows.select("o_orderkey", L.first_reason([(F.col("c_nationkey").isNull(), "no_counterpart"), (F.col("c_nationkey") >= 20, "wrong_scope"), (early, "too_early")], "joined").alias("verdict"))


_WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\bvs?\\.?\\b|\\bversus\\b', ' vs ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda x: x NOT IN ('', " + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")))"


@query(f"""WITH p AS (SELECT doc_id AS id, {_WORDS.format('text')} AS t FROM documents), b AS (SELECT item_id AS id, {_WORDS.format('text')} AS t FROM benchmark),
s AS (SELECT p.id, b.id AS r, len(list_intersect(p.t, b.t))::DOUBLE / (len(p.t) + len(b.t) - len(list_intersect(p.t, b.t))) AS sim FROM p, b WHERE len(p.t) > 0 AND len(b.t) > 0)
SELECT id, arg_max(r, (sim, -r)) AS partner, max(sim) AS similarity FROM s WHERE sim >= 0.2 GROUP BY 1""")
def title_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Of J12 the similarity: each document's words against the items', by token similarity."""
    left = table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.title_tokens(F.col("text")).alias("tokens"), F.lit(None).cast("string").alias("domain"))
    right = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), text.title_tokens(F.col("text")).alias("tokens"), F.lit(None).cast("string").alias("domain"))
    return similarity.best_partner(left, right, 0.2)


_LISTINGS = """listed AS (SELECT p_partkey, p_name, p_type, p_brand, p_size, split_part(p_name, ' ', 1) AS entity, CASE WHEN split_part(p_name, ' ', 2) IN ('ring', 'bolt') THEN 'hardware' WHEN split_part(p_name, ' ', 2) = 'widget' THEN 'goods' END AS domain FROM part),
l AS (SELECT min(p_partkey) AS id, any_value(domain) AS domain, any_value(entity) AS entity, CASE p_type WHEN 'ECONOMY' THEN 'game' WHEN 'SMALL' THEN 'season' END AS scope, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 5 END AS line, p_name || ' ' || p_type AS title FROM listed GROUP BY p_name, p_type),
r AS (SELECT min(p_partkey) AS id, any_value(domain) AS domain, any_value(entity) AS entity, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'game' WHEN p_brand LIKE 'Brand#2%' THEN 'season' END AS scope, CASE WHEN max(p_size) > 48 THEN 5 ELSE 7 END AS line, p_name || ' ' || p_brand AS title FROM listed GROUP BY p_name, p_brand)"""


@query(f"""WITH {_LISTINGS}, lt AS (SELECT *, {_WORDS.format('title')} AS t FROM l), rt AS (SELECT *, {_WORDS.format('title')} AS t FROM r),
s AS (SELECT lt.id, rt.id AS r, least(1.0::DOUBLE, len(list_intersect(lt.t, rt.t))::DOUBLE / (len(lt.t) + len(rt.t) - len(list_intersect(lt.t, rt.t))) + CASE WHEN lt.domain = rt.domain THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END) AS sim,
concat_ws(',', CASE WHEN lt.scope <> rt.scope THEN 'scope_mismatch' END, CASE WHEN lt.line <> rt.line THEN 'threshold_mismatch' END, CASE WHEN lt.entity <> rt.entity THEN 'entity_mismatch' END) AS reasons
FROM lt, rt WHERE coalesce(lt.domain = rt.domain, true) AND len(lt.t) > 0 AND len(rt.t) > 0)
SELECT id, arg_max(r, (reasons = '', sim, -r)) AS partner, arg_max(sim, (reasons = '', sim, -r)) AS similarity, arg_max(reasons, (reasons = '', sim, -r)) AS reasons FROM s WHERE sim >= 0.2 GROUP BY 1""")
def listing_partners(spark: SparkSession, d: str) -> DataFrame:
    """Two catalogues' listings by title, with the gate and bonus of a domain; scope, line and entity rule partners out, and say so where none is left.

    Listings of one title are one; so what meets grows with distinct titles, not with parts.
    """
    noun = F.split("p_name", " ")[1]
    part = table(spark, d, "part").withColumn("entity", F.split("p_name", " ")[0]).withColumn("domain", F.when(noun.isin("ring", "bolt"), "hardware").when(noun == "widget", "goods"))

    def side(key: str, scope: Column, line: Column) -> DataFrame:
        listed = part.groupBy("p_name", key).agg(F.min("p_partkey").alias("id"), F.any_value("domain").alias("domain"), F.any_value("entity").alias("entity"), F.max("p_size").alias("size"))
        return listed.select("id", "domain", text.title_tokens(F.concat_ws(" ", "p_name", key)).alias("tokens"), F.struct(scope.alias("scope"), line.alias("line"), "entity").alias("facts"))

    kind, brand = F.col("p_type"), F.col("p_brand")
    left = side("p_type", F.when(kind == "ECONOMY", "game").when(kind == "SMALL", "season"), F.when(kind.isin("ECONOMY", "STANDARD"), 5))
    right = side("p_brand", F.when(brand.startswith("Brand#1"), "game").when(brand.startswith("Brand#2"), "season"), F.when(F.col("size") > 48, 5).otherwise(7))
    vetoes = {f"{name}_mismatch": lambda a, b, fact=fact: a[fact] != b[fact] for name, fact in (("scope", "scope"), ("threshold", "line"), ("entity", "entity"))}
    return similarity.best_partner(left, right, 0.2, 0.05, vetoes)


_ARTIFACTS = """a AS (SELECT doc_id AS id, source || ':' || (doc_id // 3)::VARCHAR AS delivery, lang || ':' || (doc_id // 2)::VARCHAR AS message, sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))) AS content FROM documents)"""


@query(f"""WITH {_ARTIFACTS}, w AS (SELECT *, row_number() OVER (PARTITION BY delivery ORDER BY id) > 1 AS again, lag(content) OVER (PARTITION BY message ORDER BY id) AS was, row_number() OVER (PARTITION BY content ORDER BY id) > 1 AS spread FROM a)
SELECT id, content, CASE WHEN again THEN 'redelivery' WHEN was <> content THEN 'revision' WHEN was IS NOT NULL THEN 'restream' WHEN spread THEN 'propagation' ELSE 'novel' END AS verdict FROM w""")
def content_dedupe_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Documents as deliveries of messages; what is new in each."""
    half = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("t"), F.concat_ws(":", "source", half(3)).alias("delivery"),
        F.concat_ws(":", "lang", half(2)).alias("message"), text.content_identity(F.col("text")).alias("content"),
    )
    return dedupe.verdicts(rows).select("id", "content", "verdict")


@query("""WITH f AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 3 THEN turn + 1 WHEN turn % 7 = 6 THEN turn - 2 WHEN turn % 11 = 9 THEN NULL ELSE turn END AS seq FROM conversations), l AS (SELECT *, max(seq) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_seq FROM f)
SELECT conv_id, turn, last_seq, CASE WHEN seq IS NULL THEN 'missing' WHEN last_seq IS NULL THEN 'ok' WHEN seq = last_seq THEN 'duplicate' WHEN seq < last_seq THEN 'regression' WHEN seq > last_seq + 1 THEN 'gap' ELSE 'ok' END AS verdict FROM l""")
def sequence_audit(spark: SparkSession, d: str) -> DataFrame:
    """Turns with faults laid into their numbers, classified against the highest before."""
    turn = F.col("turn")
    seq = F.when(turn % 5 == 3, turn + 1).when(turn % 7 == 6, turn - 2).when(turn % 11 == 9, F.lit(None)).otherwise(turn)
    rows = table(spark, d, "conversations").select("conv_id", "turn", seq.alias("seq"))
    return sequences.audit(rows, "conv_id", "seq", ["turn"]).select("conv_id", "turn", "last_seq", "verdict")


# Order lines as frames of books, in SQL that both engines read alike: k is the order, n the line, s the supplier, q the quantity.
_FRAME = {
    "space": "k % 97", "market": "k", "generation": "n // 4", "kind": "CASE WHEN n = 1 OR (n = 4 AND k % 3 <> 0) THEN 'snapshot' WHEN n = 2 AND k % 11 = 0 THEN 'trade' ELSE 'delta' END",
    "side": "CASE WHEN s % 2 = 0 THEN 'yes' ELSE 'no' END", "price": "CASE WHEN n = 1 THEN s % 100 ELSE (k + n) % 40 END", "change": "CASE WHEN k % 131 <> 5 THEN CASE WHEN r = 'R' THEN -(q % 9) ELSE q END END",
}
_LEVELS = (("'yes'", "(k + 2) % 40", "q"), ("'yes'", "CASE WHEN k % 53 = 0 THEN (k + 2) % 40 ELSE (k + 5) % 40 + 40 END", "q % 7"), ("'no'", "(k + 3) % 40", "q + 1"), ("'no'", "(k + 6) % 40 + 40", "3"))


def book_frames(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as frames: first and some fourth lines are snapshots of four levels, some second ones control frames; the fourth begins a generation; numbers skip here and there and some frames come twice."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("long").alias("q"), F.col("l_returnflag").alias("r"))
    sql = lambda e: F.expr(e.replace("//", "div"))
    levels = F.when(sql(_FRAME["kind"]) == "snapshot", F.array(*[F.struct(sql(a).alias("side"), sql(b).cast("long").alias("price"), sql(c).cast("long").alias("size")) for a, b, c in _LEVELS]))
    line = line.select("k", "n", *[sql(e).alias(n) for n, e in _FRAME.items()], levels.alias("levels"), "s", "q", "r")
    order = ["n", "k", "s", "q", "r"]  # lines alike in all of these are the same frame
    turn = F.row_number().over(Window.partitionBy("space").orderBy(*order))
    numbered = Window.partitionBy("space", "generation").orderBy(*order)
    seq = F.row_number().over(numbered) + F.sum(F.when((F.col("n") == 2) & (F.col("k") % 301 == 0), 1).otherwise(0)).over(numbered.rowsBetween(Window.unboundedPreceding, 0))
    copies = F.explode(F.when((F.col("n") == 3) & (F.col("k") % 101 == 7), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    rows = line.withColumn("_turn", turn).withColumn("seq", seq.cast("long")).select("*", copies)
    return rows.select("space", "market", F.col("generation").cast("long").alias("generation"), (F.col("_turn") * 2 + F.col("copy")).cast("long").alias("turn"), "seq", "kind", "levels", "side", F.col("price").cast("long").alias("price"), F.col("change").cast("long").alias("change"))


_BOOKS = f"""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS r FROM lineitem),
f AS (SELECT k, n, s, q, r, {', '.join(f'{e} AS {n}' for n, e in _FRAME.items())} FROM l),
g AS (SELECT *, row_number() OVER (PARTITION BY space ORDER BY n, k, s, q, r) AS turn, row_number() OVER w + sum(CASE WHEN n = 2 AND k % 301 = 0 THEN 1 ELSE 0 END) OVER w AS seq FROM f WINDOW w AS (PARTITION BY space, generation ORDER BY n, k, s, q, r ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, coalesce(seq > max(seq) OVER (PARTITION BY space, generation ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, false) AS gap FROM g),
e AS (SELECT *, sum(CAST(gap AS INT)) OVER (PARTITION BY space ORDER BY turn) AS faults FROM v),
b AS (SELECT *, count(*) FILTER (WHERE kind = 'snapshot') OVER (PARTITION BY market, generation, faults ORDER BY turn) AS based FROM e WHERE kind <> 'trade'),
lv AS (SELECT market, generation, faults, based, turn, unnest([{', '.join(f"{{'side': {a}, 'price': {p}, 'size': {z}}}" for a, p, z in _LEVELS)}]) AS x FROM b WHERE kind = 'snapshot'),
bad AS (SELECT market, generation, faults, based, count(*) > count(DISTINCT (x.side, x.price)) AS rejected FROM lv GROUP BY 1, 2, 3, 4),
ch AS (SELECT market, generation, faults, based, turn, x.side AS side, x.price AS price, x.size AS size FROM lv UNION ALL SELECT market, generation, faults, based, turn, side, price, change FROM b WHERE kind = 'delta' AND based > 0),
run AS (SELECT *, sum(size) OVER (PARTITION BY market, generation, faults, based, side, price ORDER BY turn) AS level FROM ch),
halt AS (SELECT market, generation, faults, based, arg_min(CASE WHEN size IS NULL THEN 'delta_rejected' ELSE 'negative_level' END, turn) AS fault, min(turn) AS since FROM run WHERE size IS NULL OR level < 0 GROUP BY 1, 2, 3, 4),
st AS (SELECT b.*, CASE WHEN b.based = 0 THEN 'awaiting_rebase' WHEN rejected THEN 'snapshot_rejected' WHEN b.turn >= since THEN fault ELSE 'ok' END AS reason FROM b LEFT JOIN bad USING (market, generation, faults, based) LEFT JOIN halt USING (market, generation, faults, based)),
lev AS (SELECT st.market, st.turn, run.side, run.price, arg_max(run.level, run.turn) AS level FROM st JOIN run ON run.market = st.market AND run.generation = st.generation AND run.faults = st.faults AND run.based = st.based AND run.turn <= st.turn WHERE reason = 'ok' GROUP BY 1, 2, 3, 4),
top AS (SELECT market, turn, max(price) FILTER (WHERE side = 'yes' AND level > 0) AS best_yes, max(price) FILTER (WHERE side = 'no' AND level > 0) AS best_no, sum(level) AS size FROM lev GROUP BY 1, 2)
SELECT space, st.market, CAST(generation AS BIGINT) AS generation, CAST(seq AS BIGINT) AS seq, reason = 'ok' AS publishable, reason, CAST(best_yes AS BIGINT) AS best_yes, CAST(best_no AS BIGINT) AS best_no, CAST(top.size AS BIGINT) AS size FROM st LEFT JOIN top ON top.market = st.market AND top.turn = st.turn"""


@query(_BOOKS)
def book_replay(spark: SparkSession, d: str) -> DataFrame:
    """Every market's book after every frame: snapshots of levels, control frames, gaps, redeliveries, two generations."""
    return sequences.replay_books(book_frames(spark, d))


@query("""WITH o AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1), t AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1)
SELECT coalesce(o.l_orderkey, t.l_orderkey) AS l_orderkey, CAST(o.q AS BIGINT) AS ours, CAST(t.q AS BIGINT) AS theirs, CASE WHEN o.q IS NULL THEN 'only_theirs' WHEN t.q IS NULL THEN 'only_ours' ELSE 'differs' END AS kind FROM o FULL JOIN t USING (l_orderkey) WHERE o.q IS DISTINCT FROM t.q""")
def reconcile_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Two accounts of the same orders."""
    side = lambda n: table(spark, d, "lineitem").where(F.col("l_linenumber") != n).groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return sequences.reconcile(side(2), side(3), ["l_orderkey"], "q")


@query("""WITH e AS (SELECT conv_id, turn, sha256(conv_id::VARCHAR || ':' || turn::VARCHAR || ':' || coalesce(text, '')) AS dg FROM conversations), c AS (SELECT *, CASE WHEN turn % 6 = 5 THEN 'x' ELSE lag(dg) OVER (PARTITION BY conv_id ORDER BY turn) END AS pv, lag(dg) OVER (PARTITION BY conv_id ORDER BY turn) AS bf FROM e)
SELECT conv_id, count(*) AS n, min(turn) FILTER (WHERE CASE WHEN bf IS NULL THEN pv IS NOT NULL ELSE pv IS DISTINCT FROM bf END) AS first_broken FROM c GROUP BY 1""")
def hash_chain(spark: SparkSession, d: str) -> DataFrame:
    """Of R11 and G15 the links: turns as a chain of digests, some links broken; segment_verification makes the digests anew."""
    digest = F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.coalesce("text", F.lit(""))), 256)
    rows = table(spark, d, "conversations").select("conv_id", "turn", digest.alias("digest"))
    before = F.lag("digest").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = rows.withColumn("prev", F.when(F.col("turn") % 6 == 5, "x").otherwise(before))
    return sequences.verify_chain(rows, ["conv_id"], "turn", "prev", "digest")


DOCUMENT = {
    "all": [{"field": "o_totalprice", "operator": "gte", "value": 50000.0}, {"field": "o_orderstatus", "operator": "in", "value": ["O", "F"]}],
    "none": [{"field": "c_mktsegment", "operator": "eq", "value": "BUILDING"}, {"field": "c_acctbal", "operator": "lt", "value": 0.0}],
}
_MEMBERS = """m AS (SELECT o_orderkey, coalesce(o_totalprice >= 50000, false) AND coalesce(o_orderstatus IN ('O', 'F'), false) AND coalesce(o_orderdate >= TIMESTAMP '1994-01-01', false) AND NOT coalesce(c_mktsegment = 'BUILDING', false) AND NOT coalesce(c_acctbal < 0, false) AS member, (c_mktsegment IS NULL)::INT + (c_acctbal IS NULL)::INT AS kept_unknown FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 <> 0)"""


def _population(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    floor = predicates.Clause("o_orderdate", "gte", F.expr("TIMESTAMP_NTZ'1994-01-01 00:00:00'"))
    return predicates.evaluate(table(spark, d, "orders").join(people, "o_custkey", "left"), DOCUMENT, floor)


@query(f"WITH {_MEMBERS} SELECT o_orderkey, member, kept_unknown FROM m")
def predicate_population(spark: SparkSession, d: str) -> DataFrame:
    """A typed document and an injected floor, in three-valued logic."""
    return _population(spark, d).select("o_orderkey", "member", "kept_unknown")


@query(f"""WITH {_MEMBERS}, p AS (SELECT DISTINCT o_orderkey::VARCHAR AS k, o_orderkey // 1000 AS part FROM m WHERE member), g AS (SELECT part, sha256(string_agg(k, ',' ORDER BY k)) AS dg, count(*) AS n FROM p GROUP BY 1)
SELECT part, dg AS digest, n FROM g""")
def membership_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the sorted members by part of the key; the digest over parts is tested apart."""
    members = _population(spark, d).where("member").select(F.col("o_orderkey").cast("string").alias("k"), F.floor(F.col("o_orderkey") / 1000).alias("part")).distinct()
    return members.groupBy("part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("k")), ","), 256).alias("digest"), F.count("*").alias("n"))


@query(f"""WITH {TICKS}, e AS (SELECT max(t) - 7 * 86400000000 AS cut FROM ticks) SELECT type, count(*) AS n, CAST(count(*) FILTER (WHERE t < cut AND NOT cents > 9000) AS BIGINT) AS would_delete, CAST(count(*) FILTER (WHERE t < cut AND cents > 9000) AS BIGINT) AS kept_protected, min(t) AS oldest FROM ticks, e GROUP BY 1""")
def retention_dry_run(spark: SparkSession, d: str) -> DataFrame:
    """Of S13 one table: what a cut at seven days would delete, protected rows left; retention_cascade goes by dependency."""
    t = ticks(spark, d)
    cut = t.agg((F.max("t") - 7 * 86_400_000_000).alias("cut"))
    return retention.dry_run(t.join(F.broadcast(cut)), "t", F.col("cut"), ["type"], F.col("cents") > 9000)


_FATES = ("deleted", "cascaded", "kept_protected", "kept_for_child", "kept")
_DUE = {"lineitem": "l_shipdate < TIMESTAMP '1993-06-01'", "orders": "o_orderdate < TIMESTAMP '1994-01-01'", "customer": "c_acctbal < 0"}
_HELD = {"lineitem": "l_returnflag = 'R' AND l_linenumber = 6", "orders": "o_orderstatus = 'P'", "customer": "c_mktsegment = 'BUILDING'"}


@query(f"""WITH l AS (SELECT *, coalesce({_HELD['lineitem']}, false) AS held, coalesce({_DUE['lineitem']}, false) AS due FROM lineitem), o AS (SELECT *, coalesce({_HELD['orders']}, false) AS held, coalesce({_DUE['orders']}, false) AS due, o_orderkey IN (SELECT l_orderkey FROM l WHERE held) AS child FROM orders),
c AS (SELECT *, coalesce({_HELD['customer']}, false) AS held, coalesce({_DUE['customer']}, false) AS due, c_custkey IN (SELECT o_custkey FROM o WHERE held OR child) AS child FROM customer),
cf AS (SELECT c_custkey, CASE WHEN due AND NOT held AND NOT child THEN 'deleted' WHEN held AND due THEN 'kept_protected' WHEN child AND due THEN 'kept_for_child' ELSE 'kept' END AS fate FROM c),
of AS (SELECT o_orderkey, CASE WHEN due AND NOT held AND NOT child THEN 'deleted' WHEN NOT held AND NOT child AND o_custkey IN (SELECT c_custkey FROM cf WHERE fate = 'deleted') THEN 'cascaded' WHEN held AND due THEN 'kept_protected' WHEN child AND due THEN 'kept_for_child' ELSE 'kept' END AS fate FROM o),
lf AS (SELECT CASE WHEN due AND NOT held THEN 'deleted' WHEN NOT held AND l_orderkey IN (SELECT o_orderkey FROM of WHERE fate IN ('deleted', 'cascaded')) THEN 'cascaded' WHEN held AND due THEN 'kept_protected' ELSE 'kept' END AS fate FROM l),
u AS (SELECT 'customer' AS "table", fate FROM cf UNION ALL SELECT 'orders', fate FROM of UNION ALL SELECT 'lineitem', fate FROM lf)
SELECT "table", count(*) AS n, {', '.join(f"CAST(count(*) FILTER (WHERE fate = '{f}') AS BIGINT) AS {f}" for f in _FATES)} FROM u GROUP BY 1""")
def retention_cascade(spark: SparkSession, d: str) -> DataFrame:
    """What goes from three tables that belong together: children with their parents, and no parent of a protected row."""
    sql = lambda e: F.expr(e.replace("TIMESTAMP '", "TIMESTAMP_NTZ'").replace("-01'", "-01 00:00:00'"))
    of = lambda name, *edge: retention.Policy(sql(_DUE[name]), sql(_HELD[name]), *edge)
    policies = {"lineitem": of("lineitem", "orders", "l_orderkey", "o_orderkey"), "orders": of("orders", "customer", "o_custkey", "c_custkey"), "customer": of("customer")}
    return retention.plan(retention.cascade({n: table(spark, d, n) for n in policies}, policies))


@query("""WITH n AS (SELECT 'day' AS tier, date_trunc('day', o_orderdate) AS p, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders GROUP BY 2 ORDER BY 2 DESC LIMIT 7), w AS (SELECT 'week' AS tier, date_trunc('week', o_orderdate) AS p, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders GROUP BY 2 ORDER BY 2 DESC LIMIT 4), m AS (SELECT 'month' AS tier, date_trunc('month', o_orderdate) AS p, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders GROUP BY 2 ORDER BY 2 DESC LIMIT 6)
SELECT id AS o_orderkey, string_agg(tier, ',' ORDER BY tier) AS tiers FROM (FROM n UNION ALL FROM w UNION ALL FROM m) x GROUP BY 1""")
def tiered_retention(spark: SparkSession, d: str) -> DataFrame:
    """The newest of days, ISO weeks and months."""
    return retention.tiers(table(spark, d, "orders"), "o_orderdate", "o_orderkey", 7, 4, 6)


@query("SELECT CAST(coalesce(sum(strlen(CASE WHEN props <> 'null' THEN props END)), 0) AS BIGINT) AS bytes, count(*) AS n FROM (SELECT props FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) x")
def newest_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Stored bytes of the newest rows."""
    return retention.newest_bytes(table(spark, d, "events"), "props", [F.desc("ts"), F.desc("event_id")], 500)


@query("SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INT) AS place FROM orders) x WHERE place <= 3")
def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    """O2: the newest three of each key."""
    return retention.top_per_group(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "place")


@query("""SELECT brand, series, n, place FROM (SELECT p_brand AS brand, p_type AS series, count(*) AS n, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS INT) AS place FROM part GROUP BY 1, 2) x WHERE place <= 3""")
def top_series(spark: SparkSession, d: str) -> DataFrame:
    """O3: each brand's three largest series by count, ties by name; the window ranks counts, not rows."""
    counts = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("series")).agg(F.count("*").alias("n"))
    return retention.top_per_group(counts, ["brand"], [F.desc("n"), F.asc("series")], 3).select("brand", "series", "n", "place")


@query("SELECT p_partkey, p_retailprice FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49) ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def bounded_supplement(spark: SparkSession, d: str) -> DataFrame:
    """The limit comes after the exclusion, so it never hides rows that need work."""
    taken = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_retailprice").join(taken, "p_partkey", "left_anti").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)


_CYCLE, _BUDGET = 7, 40
_TIER = "CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01' THEN 0 WHEN o_orderstatus = 'P' THEN 1 WHEN o_orderstatus = 'O' THEN 2 END"


@query(f"""WITH q AS (SELECT o_orderkey, {_TIER} AS tier, row_number() OVER (ORDER BY {_TIER}, o_orderdate, o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders WHERE o_orderstatus <> 'F')
SELECT o_orderkey, tier, CAST((place - ({_CYCLE} * {_BUDGET}) % n + n) % n AS BIGINT) AS turn FROM q WHERE (place - ({_CYCLE} * {_BUDGET}) % n + n) % n < {_BUDGET}""")
def rotating_queue(spark: SparkSession, d: str) -> DataFrame:
    """Whose turn it is in the eighth round of a budget: the unsettled by urgency, read on from where the seventh ended."""
    tier = F.expr(_TIER.replace("TIMESTAMP '1996-01-01'", "TIMESTAMP_NTZ'1996-01-01 00:00:00'"))
    rows = table(spark, d, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", tier.alias("tier"), micros("o_orderdate").alias("t"))
    return selection.rotation(selection.queue_places(rows, "tier", "t", "o_orderkey", 30 * 86_400_000_000), _BUDGET, F.lit(_CYCLE)).select("o_orderkey", "tier", "turn")


_STRATA = ["high", "medium", "low"]


def _universe(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    r = ranking.placed(s, "s_acctbal", "s_suppkey", 10).join(F.broadcast(s.agg(F.count("*").alias("n"))))
    stratum = F.when(F.col("place") <= F.floor(F.col("n") / 3), "high").when(F.col("place") <= F.floor(F.col("n") * 2 / 3), "medium").otherwise("low")
    ranked = r.select("s_suppkey", stratum.alias("stratum"), F.col("s_nationkey").alias("event"), (F.col("s_nationkey") % 7).alias("series"), F.col("s_acctbal").alias("value"), "place")
    return selection.spread_picks(ranked, 4, _STRATA)


def _greedy_sql() -> str:
    """The same picks, a table per stratum: fresh events first, then the next rows."""
    out, used = "", "SELECT NULL AS event WHERE false"
    for s in _STRATA:
        out += f""", {s}_f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY place) AS turn FROM r WHERE stratum = '{s}' AND event NOT IN ({used})) WHERE turn = 1 ORDER BY place LIMIT 4),
{s}_p AS (SELECT s_suppkey, stratum, event, value, place FROM {s}_f UNION ALL (SELECT s_suppkey, stratum, event, value, place FROM r WHERE stratum = '{s}' AND s_suppkey NOT IN (SELECT s_suppkey FROM {s}_f) ORDER BY place LIMIT (SELECT 4 - count(*) FROM {s}_f)))"""
        used = f"SELECT event FROM {s}_f" if used.startswith("SELECT NULL") else f"{used} UNION SELECT event FROM {s}_f"
    return out


_UNIVERSE = f"""WITH k AS (SELECT s_suppkey, s_nationkey AS event, s_acctbal AS value, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place, count(*) OVER () AS n FROM supplier),
r AS (SELECT *, CASE WHEN place <= n // 3 THEN 'high' WHEN place <= 2 * n // 3 THEN 'medium' ELSE 'low' END AS stratum FROM k){_greedy_sql()}, u AS (FROM high_p UNION ALL FROM medium_p UNION ALL FROM low_p)"""


@query(_UNIVERSE + " SELECT s_suppkey, stratum, event FROM u")
def separated_universe(spark: SparkSession, d: str) -> DataFrame:
    """Picks of three strata that share no nation while there are others."""
    return _universe(spark, d).select("s_suppkey", "stratum", "event")


@query(_UNIVERSE + """, x AS (SELECT count(DISTINCT event) AS events, count(DISTINCT event % 7) AS series, """ + ", ".join(f"count(*) FILTER (WHERE stratum = '{s}') AS n_{s}, min(value) FILTER (WHERE stratum = '{s}') AS low_{s}, max(value) FILTER (WHERE stratum = '{s}') AS high_{s}" for s in _STRATA) + """ FROM u), m AS (SELECT max(k) AS largest FROM (SELECT event, count(*) AS k FROM u GROUP BY 1))
SELECT array_to_string(list_filter([""" + ", ".join(f"CASE WHEN n_{s} <> 4 THEN 'stratum_{s}_not_full' END" for s in _STRATA) + ", " + ", ".join(f"'{a}_over_{b}_' || CASE WHEN low_{a} = high_{b} THEN 'tied' WHEN NOT high_{b} > 0 THEN 'undefined' WHEN low_{a} / high_{b} < 2.0 THEN 'too_close' END" for a, b in zip(_STRATA, _STRATA[1:], strict=False)) + """,
CASE WHEN events < 6 THEN 'few_events' END, CASE WHEN series < 7 THEN 'few_series' END, CASE WHEN largest > 3 THEN 'one_event_dominates' END], lambda z: z IS NOT NULL), ',') AS failures FROM x, m""")
def universe_gates(spark: SparkSession, d: str) -> DataFrame:
    """Which gates the picks fail: full strata, strata apart, events and series enough, none dominating."""
    return selection.gate_failures(_universe(spark, d), 4, _STRATA, 2.0, 6, 7, 3).select(F.array_join("failures", ",").alias("failures"))


@query("""(SELECT 'urgent' AS lane, o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 30) UNION ALL (SELECT 'rest', o_orderkey FROM orders WHERE o_orderpriority NOT LIKE '1%' AND o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 20)""")
def split_budget(spark: SparkSession, d: str) -> DataFrame:
    """The earliest of two lanes, each under its own cap."""
    open_ = table(spark, d, "orders").where("o_orderstatus = 'O'")
    first = F.col("o_orderpriority").startswith("1")
    lane = lambda c, name, n: open_.where(c).orderBy("o_orderdate", "o_orderkey").limit(n).select(F.lit(name).alias("lane"), "o_orderkey")
    return lane(first, "urgent", 30).unionByName(lane(~first, "rest", 20))


@query("""WITH u AS (SELECT s_suppkey AS k, s_name AS name, 1 AS p FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT s_suppkey, 'generic ' || s_name, 2 FROM supplier) SELECT k, arg_min(name, p) AS name FROM u GROUP BY 1""")
def union_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Two scans; a key of the first one wins."""
    s = table(spark, d, "supplier")
    scans = s.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit(1).alias("p")).unionByName(s.select(F.col("s_suppkey").alias("k"), F.concat(F.lit("generic "), "s_name").alias("name"), F.lit(2).alias("p")))
    return scans.groupBy("k").agg(F.min_by("name", "p").alias("name"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) + CASE WHEN l_orderkey % 500 = 0 THEN 1 ELSE 0 END AS q FROM lineitem)
SELECT CAST((SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) AS BIGINT) AS only_left, CAST((SELECT count(*) FROM (FROM b EXCEPT ALL FROM a)) AS BIGINT) AS only_right""")
def replay_equality(spark: SparkSession, d: str) -> DataFrame:
    """U4: two replays are equal when neither has rows the other lacks; one signed count per row tells both."""
    q, changed = F.col("l_quantity").cast("long"), F.when(F.col("l_orderkey") % 500 == 0, 1).otherwise(0)
    line = table(spark, d, "lineitem")
    both = line.select("l_orderkey", "l_linenumber", q.alias("q"), F.lit(1).alias("side")).unionByName(line.select("l_orderkey", "l_linenumber", (q + changed).alias("q"), F.lit(-1).alias("side")))
    left = both.groupBy("l_orderkey", "l_linenumber", "q").agg(F.sum("side").alias("n"))
    return left.agg(F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).alias("only_left"), F.coalesce(-F.sum(F.when(F.col("n") < 0, F.col("n"))), F.lit(0)).alias("only_right"))


@query(f"""WITH {TICKS}, r AS (SELECT id, type, t, list_position(['purchase', 'signup', 'error', 'click', 'view'], type) AS pr FROM ticks) SELECT id, type, CAST(row_number() OVER (ORDER BY pr, t DESC, id) AS INT) AS place FROM r QUALIFY place <= 40""")
def promote_top(spark: SparkSession, d: str) -> DataFrame:
    """By priority of type, then newest, capped by a top-k."""
    pr = F.array_position(F.array(*[F.lit(x) for x in ("purchase", "signup", "error", "click", "view")]), F.col("type"))
    top = ticks(spark, d).withColumn("pr", pr).orderBy("pr", F.desc("t"), "id").limit(40)
    return top.select("id", "type", F.row_number().over(Window.orderBy("pr", F.desc("t"), "id")).alias("place"))


@query("""WITH r AS (SELECT s_suppkey, s_nationkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place, count(*) OVER () AS n FROM supplier), t AS (SELECT *, CASE WHEN place <= n // 3 THEN 0 WHEN place <= 2 * n // 3 THEN 1 ELSE 2 END AS stratum FROM r), e AS (SELECT *, row_number() OVER (PARTITION BY stratum, s_nationkey ORDER BY place) AS turn FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY turn, place) AS pick FROM e)
SELECT s_suppkey, stratum FROM k WHERE pick <= 8""")
def stratified_universe(spark: SparkSession, d: str) -> DataFrame:
    """Of G7 the strata: contiguous thirds of the ranking; of each, picks spread over nations before a second one is taken.

    A row after the eighth of its stratum and nation can't be picked, so few rows reach the last window.
    """
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    r = ranking.placed(s, "s_acctbal", "s_suppkey", 10).join(F.broadcast(s.agg(F.count("*").alias("n"))))
    third = lambda k: F.floor(F.col("n") * k / 3)
    t = r.withColumn("stratum", F.when(F.col("place") <= third(1), 0).when(F.col("place") <= third(2), 1).otherwise(2))
    t = t.withColumn("turn", F.row_number().over(Window.partitionBy("stratum", "s_nationkey").orderBy("place"))).where("turn <= 8")
    return t.withColumn("pick", F.row_number().over(Window.partitionBy("stratum").orderBy("turn", "place"))).where("pick <= 8").select("s_suppkey", "stratum")


@query(f"""WITH {TICKS}, b AS (SELECT key, min(t) AS o, min(t) + 900000000 AS c FROM ticks GROUP BY 1) SELECT a.key AS a, b.key AS b FROM b a JOIN b ON a.o <= b.c AND b.o <= a.c AND a.key < b.key""")
def overlapping_windows(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of keys whose windows after birth overlap; windows of one length meet in one or the next bucket of it. The pairs themselves, so as many as there are; pair_feasibility counts them without."""
    width = 900_000_000
    b = ticks(spark, d).groupBy("key").agg(F.min("t").alias("o")).withColumn("slot", F.floor(F.col("o") / width))
    left = b.select(F.col("key").alias("a"), F.col("o").alias("ao"), F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot"))
    return left.join(b.select(F.col("key").alias("b"), F.col("o").alias("bo"), "slot"), "slot").where((F.abs(F.col("ao") - F.col("bo")) <= width) & (F.col("a") < F.col("b"))).select("a", "b")


@query(f"""WITH {TICKS} SELECT key, date_trunc('day', make_timestamp(t)) AS day, count(*) AS n, CAST(count(*) FILTER (WHERE type = 'error') AS BIGINT) AS errors FROM ticks GROUP BY 1, 2""")
def usage_counters(spark: SparkSession, d: str) -> DataFrame:
    """A2, of A40 the days: requests per key and day."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("key"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), stats.count_where(F.col("event_type") == "error").alias("errors"))


@query(f"""WITH {TICKS}, s AS (SELECT key, type, unnest(['hour', 'day', 'month']) AS span, t FROM ticks)
SELECT key, span, date_trunc(span, make_timestamp(t)) AS start, count(*) AS n, CAST(count(*) FILTER (WHERE type = 'error') AS BIGINT) AS errors FROM s GROUP BY 1, 2, 3""")
def usage_by_span(spark: SparkSession, d: str) -> DataFrame:
    """Requests per key by hour, day and month; rows are counted once, by hour, and days and months are sums of hours."""
    hour = table(spark, d, "events").groupBy(F.col("user_id").alias("key"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), stats.count_where(F.col("event_type") == "error").alias("errors"))
    spans = F.array(*(F.struct(F.lit(x).alias("span"), F.date_trunc(x, "hour").cast("timestamp_ntz").alias("start")) for x in ("hour", "day", "month")))
    return hour.select("key", F.inline(spans), "n", "errors").groupBy("key", "span", "start").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))


@query("SELECT lang, source, count(*) AS n, count(DISTINCT n_chars) AS sizes FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """A1, A3, A42."""
    table(spark, d, "documents").createOrReplaceTempView("tm_documents")
    return spark.sql("SELECT lang, source, count(*) AS n, count(DISTINCT n_chars) AS sizes FROM tm_documents GROUP BY GROUPING SETS ((lang), (source), ())")


@query("""WITH n AS (SELECT o_custkey AS k, max(o_orderkey) AS id, arg_max(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), o AS (SELECT o_custkey AS k, max(o_orderkey) AS id, arg_max(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT k, coalesce(n.id, o.id) AS id, coalesce(n.status, o.status) AS status FROM n FULL JOIN o USING (k)""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """New rows take the place of old ones with their key."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    last = lambda rows: buckets.latest_per_key(rows, ["k"], ["id"], ["id", "status"])
    return buckets.upsert(last(o.where("id % 2 = 1")), last(o.where("id % 2 = 0")), ["k"])


@query("""WITH b AS (SELECT l_orderkey AS tx, l_suppkey AS mint, sum(CASE WHEN l_returnflag = 'R' THEN -CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END) AS d, count(*) AS legs, bool_or(l_linestatus = 'O') AS open FROM lineitem GROUP BY 1, 2)
SELECT tx, CAST(sum(CASE WHEN d > 0 THEN d ELSE 0 END) AS BIGINT) AS received, CAST(-sum(CASE WHEN d < 0 THEN d ELSE 0 END) AS BIGINT) AS sent, count(*) AS mints, CASE WHEN bool_or(open) THEN 'not_final' WHEN count(*) > 4 THEN 'too_many_mints' WHEN sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) = 0 THEN 'nothing_sent' ELSE 'decoded' END AS verdict FROM b GROUP BY 1""")
def balance_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Of F1 the net change per asset of an order's lines, and why one is refused; decoded_fills decodes whole transactions.

    An order has few lines of one asset, so sums before the shuffle spare nothing: lines are dealt by order, to partitions in proportion to them.
    """
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity").cast("long")).otherwise(F.col("l_quantity").cast("long"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tx"), "l_suppkey", signed.alias("signed"), (F.col("l_linestatus") == "O").alias("open"))
    per = lines.repartition(partitions(spark, lines.count()), "tx").groupBy("tx", "l_suppkey").agg(F.sum("signed").alias("d"), F.bool_or("open").alias("open"))
    spent = stats.count_where(F.col("d") < 0)
    verdict = L.first_reason([(F.bool_or("open"), "not_final"), (F.count("*") > 4, "too_many_mints"), (spent == 0, "nothing_sent")], "decoded")
    return per.groupBy("tx").agg(F.sum(F.greatest("d", F.lit(0))).alias("received"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("sent"), F.count("*").alias("mints"), verdict.alias("verdict"))


@query("""WITH c AS (SELECT l_orderkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax, CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS q FROM lineitem)
SELECT l_orderkey, CAST(sum(price) AS BIGINT) AS base, CAST(sum(price * tax) AS BIGINT) AS fee_cents100, CAST(sum(price * disc) AS BIGINT) AS rebate_cents100, CAST(max(q) AS INT) AS worst_source FROM c GROUP BY 1""")
def fee_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """parts of what a fill cost, in whole numbers, and the worst source among them."""
    whole = lambda c: F.round(F.col(c) * 100).cast("long")
    rank = F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    c = table(spark, d, "lineitem").select("l_orderkey", whole("l_extendedprice").alias("price"), whole("l_discount").alias("disc"), whole("l_tax").alias("tax"), rank.alias("q"))
    return c.groupBy("l_orderkey").agg(F.sum("price").alias("base"), F.sum(F.col("price") * F.col("tax")).alias("fee_cents100"), F.sum(F.col("price") * F.col("disc")).alias("rebate_cents100"), F.max("q").alias("worst_source"))


@query(f"""WITH {TICKS}, p AS (SELECT key, map_from_entries(list((type, n))) AS m FROM (SELECT key, type, count(*) AS n FROM ticks GROUP BY 1, 2) x GROUP BY 1) SELECT key, coalesce(m['view'], 0) AS views, coalesce(m['purchase'], 0) AS purchases, len(map_keys(m)) AS kinds FROM p""".replace("SELECT key, coalesce(m['view'], 0) AS views, coalesce(m['purchase'], 0) AS purchases, len(map_keys(m)) AS kinds FROM p", "SELECT key, coalesce(element_at(m, 'view')[1], 0) AS views, coalesce(element_at(m, 'purchase')[1], 0) AS purchases, CAST(cardinality(m) AS INT) AS kinds FROM p"))
def distribution_maps(spark: SparkSession, d: str) -> DataFrame:
    """Counts by kind as a map per key, merged from groups."""
    by = ticks(spark, d).groupBy("key", "type").count()
    m = by.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("type", "count"))).alias("m"))
    at = lambda k: F.coalesce(F.element_at("m", F.lit(k)), F.lit(0))
    return m.select("key", at("view").alias("views"), at("purchase").alias("purchases"), F.size("m").alias("kinds"))


@query("""SELECT conv_id, count(*) AS n, CAST(count(text) AS BIGINT) AS with_text, CAST(count(*) FILTER (WHERE text = '') AS BIGINT) AS empty, count(role) AS with_role FROM conversations GROUP BY 1""")
def field_coverage(spark: SparkSession, d: str) -> DataFrame:
    """A39, of G11 the fields: what is there and what is absent."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count("text").alias("with_text"), stats.count_where(F.col("text") == "").alias("empty"), F.count("role").alias("with_role"))


@query("""SELECT page_id, CASE WHEN strlen(html) > 1500 THEN 'envelope' ELSE 'captured' END AS mode, sha256(html) AS digest, strlen(html) AS bytes, CASE WHEN strlen(html) <= 1500 THEN html END AS payload FROM pages""")
def payload_capture(spark: SparkSession, d: str) -> DataFrame:
    """A payload over the size is kept as its digest and size only."""
    size = F.octet_length("html")
    return table(spark, d, "pages").select("page_id", F.when(size > 1500, "envelope").otherwise("captured").alias("mode"), F.sha2("html", 256).alias("digest"), size.cast("long").alias("bytes"), F.when(size <= 1500, F.col("html")).alias("payload"))


@query("""SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 0 ELSE greatest(100 - least(45, 15 * ((regexp_matches(lower(text), '\\bidiot\\b'))::INT + (regexp_matches(lower(text), '\\bclown\\b'))::INT + (regexp_matches(lower(text), '\\bloser\\b'))::INT + (regexp_matches(lower(text), '\\bscum\\b'))::INT)) - CASE WHEN regexp_matches(lower(text), 'https?://|according to ') THEN 0 ELSE 25 END
- CASE WHEN regexp_matches(lower(text), 'all of the following|in combination') OR len(string_split(lower(text), ' and ')) > 3 THEN 20 ELSE 0 END - CASE WHEN length(text) < 40 THEN 20 ELSE 0 END, 0) END AS points FROM documents""")
def text_clarity(spark: SparkSession, d: str) -> DataFrame:
    """Of P7 a plain form: rule-based clarity of a text, in hundredths."""
    points = text.text_clarity(F.col("text"), ["idiot", "clown", "loser", "scum"], ["all of the following", "in combination"], "https?://|according to ")
    return table(spark, d, "documents").select("doc_id", points.alias("points"))


_RULES = "CASE WHEN doc_id % 29 = 0 THEN '  ' WHEN doc_id % 6 = 0 THEN left(text, 30) WHEN doc_id % 5 = 0 THEN concat(left(text, 200), ' As Reported by the League; and so on') WHEN doc_id % 4 = 0 THEN concat('A major and likely and notable and serious change, see example.org/x. ', left(text, 90)) WHEN doc_id % 7 = 0 THEN concat('In combination, official results of the day. ', left(text, 80)) ELSE left(text, 400) END"


def _clarity_sql() -> str:
    source = "coalesce(" + ", ".join("nullif(trim(regexp_extract(r, '" + p.replace("'", "''") + "', 1, 'i')), '')" for p in text.SOURCE_PATTERNS) + ")"
    terms = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(b, '\\b{t}\\b') THEN '{t}' END" for t in sorted(text.SUBJECTIVE_TERMS)) + "], lambda x: x IS NOT NULL)"
    return f"""WITH d AS (SELECT doc_id, regexp_replace(coalesce({_RULES}, ''), '^\\s+|\\s+$', '', 'g') AS r, lower(concat(coalesce(lang, ''), ' significant')) AS title FROM documents), e AS (SELECT *, title || ' ' || lower(r) AS b FROM d),
f AS (SELECT *, {terms} AS terms, CASE WHEN r <> '' THEN {source} END AS source, regexp_matches(lower(r), '{"|".join(text.MULTI_CONDITION_MARKERS)}') OR len(string_split(lower(r), ' and ')) > 3 AS several, length(r) < {text.LEAST_LENGTH} AS short FROM e),
g AS (SELECT *, CASE WHEN r = '' THEN 0 ELSE greatest(0, 100 - least({text.MOST_OF_TERMS}, {text.EACH_TERM} * len(terms)) - CASE WHEN source IS NULL THEN {text.NO_SOURCE} ELSE 0 END - CASE WHEN several THEN {text.SEVERAL} ELSE 0 END - CASE WHEN short THEN {text.TOO_SHORT} ELSE 0 END) END AS points FROM f)
SELECT doc_id, CAST(points AS INTEGER) AS points, CASE WHEN r = '' THEN 'unknown' WHEN points >= {text.LOW_RISK} THEN 'low' WHEN points >= {text.MEDIUM_RISK} THEN 'medium' ELSE 'high' END AS risk, CASE WHEN r = '' THEN 'needs_manual_review' WHEN points >= {text.RESEARCHABLE} THEN 'researchable' WHEN points >= {text.AVOID} THEN 'needs_manual_review' ELSE 'avoid' END AS tradeability, source AS settlement_source,
CASE WHEN r = '' THEN 'missing_rules_text' ELSE array_to_string(list_concat(list_transform(terms, lambda x: 'subjective_wording:' || x), list_filter([CASE WHEN source IS NULL THEN 'unclear_settlement_source' END, CASE WHEN several THEN 'multi_condition_phrasing' END, CASE WHEN short THEN 'rules_text_too_short' END], lambda x: x IS NOT NULL)), ',') END AS flags FROM g"""


@query(_clarity_sql())
def resolution_clarity(spark: SparkSession, d: str) -> DataFrame:
    """How clear rules are, by all terms, ways of naming a source and signs of several conditions, with what it means for use."""
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("lang", F.lit("")), F.lit(" significant")).alias("title"), F.expr(_RULES).alias("rules"))
    out = text.with_clarity(rows, "title", "rules")
    return out.select("doc_id", "points", "risk", "tradeability", "settlement_source", F.array_join("flags", ",").alias("flags"))


@query()
def base58_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses from digests, and back."""
    rows = table(spark, d, "customer").select("c_custkey", F.unhex(F.sha2(F.col("c_name"), 256)).alias("raw"))
    coded = rows.withColumn("address", codec.base58("raw"))
    return coded.select("c_custkey", "address", (codec.unbase58("address") == F.col("raw")).alias("round_trip"))


@query()
def canonical_payloads(spark: SparkSession, d: str) -> DataFrame:
    """2.8: payload text in canonical form and its digest."""
    rows = table(spark, d, "events").select("event_id", codec.canonical_json("props").alias("canonical"))
    return rows.withColumn("digest", F.sha2("canonical", 256))


@query(f"""WITH {TICKS}, a AS (SELECT key, min(t) AS t FROM ticks GROUP BY 1), h AS (SELECT * FROM (VALUES ('15m', 900000000), ('1h', 3600000000), ('24h', 86400000000), ('7d', 604800000000)) v(horizon, w)), e AS (SELECT max(t) AS now FROM ticks),
o AS (SELECT a.key, horizon, w, now, a.t, EXISTS (SELECT 1 FROM ticks b WHERE b.key = a.key AND b.t > a.t + w - w // 4 AND b.t <= a.t + w + w // 4) AS seen FROM a, h, e)
SELECT horizon, CASE WHEN seen THEN 'observed' WHEN now < t + w + w // 4 THEN 'not_yet_due' ELSE 'permanently_missing' END AS cause, count(*) AS n FROM o GROUP BY 1, 2""")
def observation_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Members and horizons by whether their band was observed, and why not."""
    from ..operators.asof import interval_semi

    t = ticks(spark, d)
    members = t.groupBy("key").agg(F.min("t").alias("t"))
    widths = {"15m": 900_000_000, "1h": 3_600_000_000, "24h": 86_400_000_000, "7d": 604_800_000_000}
    seen = interval_semi(members, t, "key", "t", [(h, w, w // 4) for h, w in widths.items()])
    # the band is open at its lower end
    now = t.agg(F.max("t").alias("now"))
    ends = F.create_map(*[x for h, w in widths.items() for x in (F.lit(h), F.lit(w + w // 4))])
    cause = F.when(F.col("observed"), "observed").when(F.col("now") < F.col("t") + ends[F.col("horizon")], "not_yet_due").otherwise("permanently_missing")
    return seen.join(F.broadcast(now)).groupBy("horizon", cause.alias("cause")).agg(F.count("*").alias("n"))


_BANDS, _KEPT, _GRACE = {"15m": 900_000_000, "24h": 86_400_000_000, "7d": 604_800_000_000}, 20 * 86_400_000_000, 2 * 86_400_000_000


@query(f"""WITH {TICKS}, a AS (SELECT key, min(t) AS t, arg_min(cents, (t, id)) AS first_cents FROM ticks GROUP BY 1), h AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {w})" for n, w in _BANDS.items())}) v(horizon, w)), e AS (SELECT max(t) AS now FROM ticks),
o AS (SELECT a.key, a.t, first_cents, horizon, w, now, EXISTS (SELECT 1 FROM ticks b WHERE b.key = a.key AND b.t BETWEEN a.t + w - w // 4 AND a.t + w + w // 4) AS seen FROM a, h, e)
SELECT horizon, CASE WHEN first_cents IS NULL OR first_cents < 300 THEN 'missing_initial_state' WHEN seen THEN 'complete' WHEN now < t + w - w // 4 THEN 'not_yet_due' WHEN now <= t + w + w // 4 THEN 'due_now' WHEN now - t > {_KEPT} THEN 'retention_lost' WHEN now <= t + w + w // 4 + {_GRACE} THEN 'recoverable' ELSE 'no_observation_in_window' END AS state, count(*) AS n FROM o GROUP BY 1, 2""")
def backlog_ladder(spark: SparkSession, d: str) -> DataFrame:
    """J20 over J18 and J19: why a key's window at each horizon is or isn't had: first by its initial value, then by whether its band was observed, then by when it is due and how long rows are kept."""
    t = ticks(spark, d)
    members = t.groupBy("key").agg(F.min("t").alias("t"), F.min_by("cents", F.struct("t", "id")).alias("first_cents"))
    seen = asof.interval_semi(members, t, "key", "t", [(h, w, w // 4) for h, w in _BANDS.items()])
    rows = seen.join(members, ["key", "t"]).join(F.broadcast(t.agg(F.max("t").alias("now"))))
    width = F.create_map(*[x for h, w in _BANDS.items() for x in (F.lit(h), F.lit(w))])[F.col("horizon")]
    opens, closes = F.col("t") + width - F.floor(width / 4), F.col("t") + width + F.floor(width / 4)
    now = F.col("now")
    state = L.first_reason([
        (F.coalesce(F.col("first_cents") < 300, F.lit(True)), "missing_initial_state"), (F.col("observed"), "complete"), (now < opens, "not_yet_due"), (now <= closes, "due_now"), (now - F.col("t") > _KEPT, "retention_lost"), (now <= closes + _GRACE, "recoverable"),
    ], "no_observation_in_window")
    return rows.groupBy("horizon", state.alias("state")).agg(F.count("*").alias("n"))


@query("SELECT event_id, epoch_us(ts) AS at, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def typed_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Of G4 the fields of a JSON payload by schema, filtered."""
    p = F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})
    return table(spark, d, "events").select("event_id", micros("ts").alias("at"), p["k"].alias("k")).where("k >= 50")
