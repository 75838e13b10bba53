"""Sparse search: the reference cases and hand-computed ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexidra.operators import postings as P
from lexidra.operators import search as S
from lexidra.operators.lexical import bm25_postings, bm25_search, doc_tokens, query_term_counts, term_frequencies
from lexidra.operators.pooling import splade_pooling
from lexidra.operators.ranking import batch_id, first_rows, rank_topk, with_ordinal


def vectors(spark, rows, name="doc_id"):
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<double>")


def index(spark, rows):
    return P.to_sparse(vectors(spark, rows))


def query(spark, *rows):
    return P.to_sparse(vectors(spark, list(enumerate(rows)), "query_id"), "query_id").select("query_id", "term", "weight")


def hits(run):
    return [(r.query_id, r.doc_id, r.score) for r in run.orderBy("query_id", "rank").collect()]


def test_two_rows_write_and_search(spark):
    postings = index(spark, [(0, [0.0, 1.0, 0.0]), (1, [1.0, 0.0, 1.0])])
    assert {(r.dim, r.doc_id, r.weight) for r in postings.collect()} == {(0, 1, 1.0), (1, 0, 1.0), (2, 1, 1.0)}
    assert hits(S.sparse_dot_search(query(spark, [0.0, 1.0, 0.0]), postings, 1)) == [(0, 0, 1.0)]
    assert hits(S.sparse_dot_search(query(spark, [1.0, 0.0, 1.0]), postings, 1)) == [(0, 1, 2.0)]
    assert hits(S.sparse_dot_search(query(spark, [0.0, 0.0, 0.0]), postings, 1)) == []


def test_three_rows_in_three_forms(spark):
    rows = [(0, [0.0, 3.5, 0.0]), (1, [4.5, 0.0, 5.5]), (2, [0.0, 6.5, 0.0]), (3, [0.0, 0.0, 9.0])]
    postings, q = index(spark, rows), query(spark, [1.0, 2.0, 0.0])
    matched = [(0, 2, 13.0), (0, 0, 7.0), (0, 1, 4.5)]
    assert hits(S.sparse_dot_search(q, postings, 10)) == matched
    docs = vectors(spark, rows).select("doc_id")
    for clamp in (False, True):
        assert hits(S.weighted_sum_all_docs(q, postings, docs, 10, clamp)) == matched + [(0, 3, 0.0)]


def test_all_documents_with_negative_scores(spark):
    rows = [(0, [0.0, -1.0]), (1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, -3.0]), (4, [0.0, 0.0])]
    postings, q, docs = index(spark, rows), query(spark, [1.0, 1.0]), vectors(spark, rows).select("doc_id")
    assert hits(S.weighted_sum_all_docs(q, postings, docs, 4)) == [(0, 2, 2.0), (0, 1, 0.0), (0, 4, 0.0), (0, 0, -1.0)]
    clamped = [(0, 2, 2.0), (0, 0, 0.0), (0, 1, 0.0), (0, 3, 0.0)]
    assert hits(S.weighted_sum_all_docs(q, postings, docs, 4, True)) == clamped


def test_vector_shapes(spark):
    nested = spark.createDataFrame([(0, [[0.0, 2.0]])], "doc_id bigint, embedding array<array<double>>")
    assert [(r.dim, r.weight) for r in P.to_sparse(nested).collect()] == [(1, 2.0)]
    wide = spark.createDataFrame([(0, [[0.0], [2.0]])], "doc_id bigint, embedding array<array<double>>")
    with pytest.raises(Exception, match="shape"):
        P.to_sparse(wide).collect()
    with pytest.raises(ValueError, match="shape"):
        P.to_sparse(spark.createDataFrame([(0, "x")], "doc_id bigint, embedding string"))


def test_weights_are_scaled_and_checked(spark):
    terms = spark.createDataFrame([(0, "a", 128.0), (0, "b", 1.0), (1, "a", 3.0)], "query_id int, term string, weight double")
    rows = {(r.query_id, r.term): r.weight for r in P.prepare_query_weights(terms).collect()}
    assert rows == {(0, "a"): 64.0, (0, "b"): 0.5, (1, "a"): 3.0}
    plain = P.prepare_query_weights(terms.drop("weight"), weighted=False)
    assert {r.weight for r in plain.collect()} == {1.0}
    for bad in (float("nan"), float("inf"), float("-inf")):
        wrong = spark.createDataFrame([(0, "a", bad)], "query_id int, term string, weight double")
        with pytest.raises(Exception, match="finite"):
            P.check_query_weights(wrong).collect()


def test_min_should_match(spark):
    postings = spark.createDataFrame(
        [("a", 0, 1.0), ("b", 0, 1.0), ("a", 1, 5.0), ("c", 2, 1.0)], "term string, doc_id bigint, weight double"
    )
    terms = spark.createDataFrame([(0, t, 1.0) for t in "abc"], "query_id int, term string, weight double")
    for ratio, docs in ((0.0, {0, 1, 2}), (0.1, {0, 1, 2}), (0.5, {0}), (1.0, set())):
        found = S.sparse_dot_search(terms, postings, 10, min_match_ratio=ratio)
        assert {r.doc_id for r in found.collect()} == docs


def test_unweighted_and_token_bag(spark):
    postings = spark.createDataFrame([("a", 0, 2.0), ("b", 0, 1.0), ("a", 1, 4.0)], "term string, doc_id bigint, weight double")
    terms = spark.createDataFrame([(0, "a", 9.0), (0, "a", 9.0), (0, "b", 9.0)], "query_id int, term string, weight double")
    assert hits(S.unweighted_search(terms, postings, 5)) == [(0, 1, 4.0), (0, 0, 3.0)]
    bag = spark.createDataFrame([(0, "a"), (0, "a"), (0, "b"), (0, "zz")], "query_id int, token string")
    assert hits(S.token_bag_search(bag, postings, 5)) == [(0, 1, 8.0), (0, 0, 5.0)]


def test_ranking_of_one_hot_group(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 < 2, F.lit(0)).otherwise(F.col("id")).alias("query_id"),
        F.col("id").alias("doc_id"),
        (F.col("id") % 7).cast("double").alias("score"),
    )
    for k in (3, 1500):
        got = rank_topk(rows, k).where("query_id = 0").orderBy("rank").select("doc_id", "rank").collect()
        pool = [(-(i % 7), i) for i in range(5000) if i % 3 < 2 or i == 0]
        assert [r.doc_id for r in got] == [i for _, i in sorted(pool)[:k]]
        assert [r["rank"] for r in got] == list(range(1, len(got) + 1))


def test_ordinals_without_a_global_window(spark):
    rows = spark.range(1000).select((F.col("id") * F.col("id")).alias("key")).repartition(5)
    got = [(r["key"], r.ordinal) for r in with_ordinal(rows, "key", buckets=7).orderBy("key").collect()]
    assert got == [(i * i, i) for i in range(1000)]
    assert [r.batch_id for r in batch_id(rows, "key", 300).orderBy("key").collect()] == [i // 300 for i in range(1000)]
    assert {r["key"] for r in first_rows(rows, "key", 10).collect()} == {i * i for i in range(10)}
    with pytest.raises(ValueError):
        batch_id(rows, "key", 0)


def test_term_counts_inside_the_row(spark):
    docs = spark.createDataFrame([(0, "b a b! A"), (1, ""), (2, None), (3, "é é x")], "doc_id bigint, text string")
    rows = {(r.doc_id, r.term): (r.tf, r.dl) for r in term_frequencies(doc_tokens(docs)).collect()}
    assert rows == {(0, "a"): (2, 4), (0, "b"): (2, 4), (3, "é"): (2, 3), (3, "x"): (1, 3)}


def test_bm25_counts_repeated_query_tokens(spark):
    docs = spark.createDataFrame([(0, "red fox"), (1, "red red dog"), (2, "cat")], "doc_id bigint, text string")
    once = spark.createDataFrame([(0, "red")], "query_id int, text string")
    twice = spark.createDataFrame([(0, "Red red unknown")], "query_id int, text string")
    one, two = hits(bm25_search(once, docs, 5)), hits(bm25_search(twice, docs, 5))
    assert [h[1] for h in one] == [1, 0] and [h[1] for h in two] == [1, 0]
    assert two[0][2] == pytest.approx(2 * one[0][2], abs=1e-8)
    stored = bm25_postings(doc_tokens(docs))
    assert hits(S.sparse_dot_search(query_term_counts(twice), stored, 5)) == two


def test_documents_are_scored_in_their_tasks(spark):
    """No sums of (query, document) are aggregated over a task or shuffled; the hits are those of the join."""
    words = ["ash", "birch", "cedar", "elm", "fir", "oak"]
    texts = [(i, " ".join(words[(i * j) % 6] for j in range(1 + i % 17))) for i in range(300)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame([(0, "ash ash oak"), (1, "fir"), (2, "none"), (None, "elm birch")], "query_id long, text string")
    found = bm25_search(queries, docs, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "keys=[query_id" not in plan
    columns = ["query_id", "doc_id", "score", "rank"]
    want = sorted(map(str, bm25_search(queries, docs, 7, ship_bytes=0).select(columns).collect()))
    assert sorted(map(str, found.select(columns).collect())) == want and len(want) == 21
    assert "keys=[query_id" in bm25_search(queries, docs, 7, ship_bytes=0)._jdf.queryExecution().executedPlan().toString()
    # Rows that share an id are one document, wherever they are.
    twice = docs.unionByName(docs.where("doc_id % 3 = 0"))
    want = sorted(map(str, bm25_search(queries, twice, 7, ship_bytes=0).select(columns).collect()))
    assert sorted(map(str, bm25_search(queries, twice, 7).select(columns).collect())) == want


def test_shipped_terms_score_like_joined_ones(spark):
    rng = np.random.default_rng(5)
    postings = [(f"t{t}", f"d{d:03}", float(rng.normal())) for d in range(200) for t in rng.choice(40, 12, replace=False)]
    terms = [(f"q{q}", f"t{t}", float(rng.integers(-3, 4))) for q in range(6) for t in range(0, 50, q + 1)]
    postings = spark.createDataFrame(postings, "term string, doc_id string, weight double").repartition(7, "term")
    terms = spark.createDataFrame([*terms, ("q0", "t0", 1.0), ("q1", None, 1.0)], "query_id string, term string, weight double")
    # Batches of three rows: documents go on from batch to batch.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for k, ratio in ((1, 0.0), (9, 0.0), (9, 0.2), (500, 0.3)):
            got = S.sparse_dot_search(terms, postings, k, min_match_ratio=ratio)
            want = S.sparse_dot_search(terms, postings, k, min_match_ratio=ratio, ship_bytes=0)
            columns = ["query_id", "doc_id", "score", "rank"]
            assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_scores_beyond_the_fixed_point_are_refused(spark):
    postings = spark.createDataFrame([("a", 1, 6e9), ("b", 1, 6e9)], "term string, doc_id long, weight double")
    terms = spark.createDataFrame([(0, "a", 1.0), (0, "b", 1.0)], "query_id long, term string, weight double")
    with pytest.raises(Exception, match="fixed point"):
        S.sparse_dot_search(terms, postings, 3).collect()


def test_pooled_terms_that_nobody_asks_for_are_not_shuffled(spark):
    """The asked terms filter the rows below the pooling that makes the postings."""
    logits = spark.createDataFrame([(d, p, f"t{p % 9}", float(p - 3)) for d in range(20) for p in range(30)], "doc_id long, pos long, term string, logit double")
    terms = spark.createDataFrame([(0, "t1", 1.0), (0, "t5", 2.0), (1, "t8", 1.0)], "query_id long, term string, weight double")
    pooled = splade_pooling(logits)
    found = S.sparse_dot_search(terms, pooled, 4, max_weight=None)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")
    columns = ["query_id", "doc_id", "score", "rank"]
    want = S.sparse_dot_search(terms, pooled, 4, max_weight=None, ship_bytes=0)
    assert sorted(found.select(columns).collect()) == sorted(want.select(columns).collect())
