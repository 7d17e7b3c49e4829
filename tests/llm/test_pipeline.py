"""The dedup stages of the pipeline decide row by row."""

from collections import Counter

import corpus_pipeline
from test_dedup import brute_components, normalised


def in_order(rows):
    """Rows by (doc_id, place), nulls last: the first of copies stays."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def without_copies(rows):
    first = {}
    for d, t in in_order(rows):
        first.setdefault(normalised(t), (d, t))
    return list(first.values())


def without_near_copies(rows):
    numbered = [(i, t) for i, (_, t) in enumerate(in_order(rows))]
    of = brute_components(numbered, 80)
    return [r for i, r in enumerate(in_order(rows)) if of[i][1] == i]


def left(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_decide_by_row(spark, odd_rows, empty, data):
    some = [f"v{i}" for i in range(60)]
    text, close, other = " ".join(some), " ".join(some[:-1] + ["x"]), " ".join(f"u{i}" for i in range(60))
    # A null copy and near copy, a row loaded twice, and an id whose texts are a copy, a near copy and a clean one.
    rows = odd_rows + [(200, text), (None, text), (None, close), (200, text), (201, text), (201, close), (201, other), (None, other + " end")]
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string").repartition(3, "text")
    want = without_copies(rows)
    exact = corpus_pipeline.written(corpus_pipeline.exact(spark, docs, data), "exact")
    assert exact.columns == docs.columns
    assert left(exact) == Counter(want)
    assert left(exact)[(201, other)] == 1
    near = corpus_pipeline.near(spark, exact, data)
    assert near.columns == docs.columns
    assert left(near) == Counter(without_near_copies(want))
    assert {d for d, t in left(near) if t in (text, close, other, other + " end")} == {200, 201}
    assert corpus_pipeline.near(spark, corpus_pipeline.exact(spark, empty, data), data).count() == 0


def test_columns_with_names_used_inside(spark, data):
    docs = spark.createDataFrame([(1, "a b", "X", "Y", 5), (2, "a  b", "X", "Y", 5), (3, "c", "Z", None, 6)], "doc_id long, text string, _row string, row string, Row_ int")
    for stage in (corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.secrets, corpus_pipeline.toxicity):
        docs = stage(spark, docs, data)
    assert sorted(tuple(r) for r in docs.collect()) == [(1, "a b", "X", "Y", 5), (3, "c", "Z", None, 6)]


def test_a_worker_keeps_the_memos_of_one_stage(spark):
    """Workers go from stage to stage; memos of packing and near dedup that stay behind took an executor beyond its memory in exact dedup."""
    from tidemark.llm.exact_dedup import exact_dedup
    from tidemark.llm.near_dedup import near_dedup
    from tidemark.llm.packing import pack

    docs = spark.range(200).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 40), x -> concat('w', x * id))) AS text").repartition(1)

    def held(batches):
        import pyarrow as pa

        from tidemark.llm import near_dedup, tokens

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([tokens._ids_memo.cache_info().currsize]), pa.array([len(near_dedup._words)])], ["memos", "words"])

    # More tasks than cores, so that each worker of the pool tells.
    def peek():
        return [tuple(r) for r in spark.range(8).repartition(8).mapInArrow(held, "memos long, words long").collect()]

    written = [f(docs) for f in (pack, near_dedup, exact_dedup)]
    written[0].collect()
    assert max(m for m, _ in peek()) == 1
    for _ in range(4):  # till all workers of the pool had a task
        exact_dedup(docs.repartition(8)).collect()
    assert set(peek()) == {(0, 0)}
    assert {r["doc_id"] for r in written[1].collect()} == {r["doc_id"] for r in written[2].collect()} == set(range(200))
