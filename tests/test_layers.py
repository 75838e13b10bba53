"""Shipped and joined layers mean the same; encoders work in steps; first rows by key."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexidra.operators import encoders, search
from lexidra.operators.ranking import first_rows
from lexidra.plans.variational import VariationalModel, encode_variational

VECTORS = "vec_id bigint, vec array<double>"
WEIGHTS = "out bigint, inp bigint, w double"
BIAS = "out bigint, b double"

LAYERS = {
    "plain": ([(0, 0, 1.0), (0, 1, 2.0), (1, 0, -1.0)], [(0, 0.5), (1, 0.25)]),
    "output without a weight": ([(0, 0, 1.0), (2, 1, 1.0)], [(0, 0.5), (1, 0.25), (2, 0.5)]),
    "bias beyond the weights": ([(0, 0, 1.0)], [(3, 2.0)]),
    "missing bias rows": ([(0, 0, 1.0), (1, 1, 3.0)], [(1, 1.0)]),
    "repeated rows": ([(0, 0, 1.0), (0, 0, 2.0), (1, 1, 1.0)], [(0, 1.0), (0, 1.0)]),
    "inputs beyond the vector": ([(0, 0, 1.0), (0, 7, 5.0)], [(0, 0.0)]),
    "no bias": ([(1, 0, 1.0)], None),
    "nothing": ([], []),
}


@pytest.mark.parametrize("kind", sorted(LAYERS))
@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_layer_means_the_same_shipped_and_joined(spark, monkeypatch, kind, bound):
    monkeypatch.setattr(encoders, "SHIP_BYTES", bound)
    weights, bias = LAYERS[kind]
    vectors = [(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.5])]
    outs = 1 + max([w[0] for w in weights] + [b[0] for b in bias or []], default=-1)
    want = {}
    for i, x in vectors:
        y = [0.0] * outs
        for o, n, w in weights:
            y[o] += w * x[n] if n < len(x) else 0.0
        for o, b in bias or []:
            y[o] += b
        want[i] = [v if v > 0 else 0.1 * v for v in y]
    layer = encoders.Layer(
        spark.createDataFrame(weights, WEIGHTS), None if bias is None else spark.createDataFrame(bias, BIAS), "lrelu", 0.1
    )
    df = spark.createDataFrame(vectors, VECTORS).withColumn("other", F.lit("kept"))
    out = encoders.apply_layers(df, [layer])
    assert out.columns == df.columns
    assert {r.vec_id: r.vec for r in out.collect()} == {i: pytest.approx(v) for i, v in want.items()}


@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_decoding_means_the_same_shipped_and_joined(spark, monkeypatch, bound):
    monkeypatch.setattr(encoders, "SHIP_BYTES", bound)
    latents = [(1, 0, 1.0), (1, 0, 2.0), (1, 2, 1.0), (2, 9, 4.0), (3, 1, 1.0)]
    decoder = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [5.0, 5.0]), (2, [0.5, 0.5])]
    rows = spark.createDataFrame(latents, "vec_id bigint, dim bigint, weight double")
    model = spark.createDataFrame(decoder, "latent bigint, vec array<double>")
    pre = spark.createDataFrame([(0, 0.0), (1, 10.0)], "dim bigint, b double")
    docs = spark.createDataFrame([(i,) for i in range(1, 5)], "vec_id bigint")
    got = {r.vec_id: r.vec for r in encoders.linear_decode(rows, model, pre, docs, 2).collect()}
    assert got == {1: [3.5, 10.5], 2: [0.0, 10.0], 3: [5.0, 16.0], 4: [0.0, 10.0]}


def test_plugged_encoders_see_bounded_batches(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id bigint, text string").coalesce(1)

    def of_texts(texts):
        assert len(texts) <= 7
        return np.array([[float(len(t)), 1.0] for t in texts])

    assert {r.doc_id: r.vec[0] for r in encoders.encode_texts(docs, of_texts, batch_size=7).collect()} == {i: float(len(f"text {i}")) for i in range(50)}

    def of_tokens(lists):
        assert len(lists) <= 7
        return [np.full((len(tokens), 2), float(len(lists))) for tokens in lists]

    tokens = docs.select("doc_id", F.split("text", " ").alias("tokens"))
    assert encoders.encode_tokens(tokens, of_tokens, batch_size=7).count() == 100


def test_first_rows_filter_by_key(spark):
    df = spark.createDataFrame([(i * 7 % 101, "x") for i in range(100)], "k bigint, v string")
    keys = sorted(i * 7 % 101 for i in range(100))
    for n in (1, 30, 100, 500):
        assert sorted(r.k for r in first_rows(df, "k", n).collect()) == keys[:n]
    assert first_rows(df, "k", 0).count() == 0


def test_all_documents_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(search, "ORDINALS", 3)
    docs = spark.range(40).withColumnRenamed("id", "doc_id")
    postings = spark.createDataFrame([("a", 5, -1.0), ("a", 7, 2.0)], "term string, doc_id bigint, weight double")
    terms = spark.createDataFrame([(1, "a", 1.0)], "query_id int, term string, weight double")
    got = [r.doc_id for r in search.weighted_sum_all_docs(terms, postings, docs, 20).orderBy("rank").collect()]
    assert got == [7, *[d for d in range(21) if d not in (5, 7)]][:20]


def test_variational_latents_repeat_and_differ_by_seed(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], VECTORS)
    centroids = spark.createDataFrame([(0, [0.0, 1.0]), (1, [5.0, 1.0])], "cluster bigint, vec array<double>")
    weights = spark.createDataFrame([(o, n, 0.1 * (o - n)) for o in range(5) for n in range(4)], WEIGHTS)
    bias = spark.createDataFrame([(o, 0.1) for o in range(5)], BIAS)
    model = VariationalModel(centroids, [(weights, bias)], [(weights, bias)])

    def encoded(**options):
        rows = encode_variational(vectors, model, **options).collect()
        return sorted((r.vec_id, r.dim, r.weight) for r in rows)

    assert encoded(seed=1) == encoded(seed=1) != encoded(seed=2)
    assert len(encoded()) == 30 and len(encoded(threshold=0.25)) < 30
    assert all(abs(w) >= 0.5 for _, _, w in encoded(threshold=0.5, zeroing="threshold"))


def test_encoder_factory(spark):
    rows = [(i, ["t"] * (i * 7 % 23)) for i in range(200)] + [(200, None), (201, ["t"] * 500)]
    tokens = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>").repartition(6)

    def load():
        made = uuid.uuid4().int % (1 << 50)

        def encode(lists):
            longest = max(map(len, lists))
            # One document may be longer than a batch; among others nothing is far shorter than the longest.
            assert len(lists) == 1 or longest * len(lists) <= 64
            return [np.full((len(t), 2), [float(made), float(os.getpid())]) for t in lists]

        return encode

    vectors = encoders.encode_tokens_with(tokens, load, batch_tokens=64, bucket_rows=50)
    got = vectors.collect()
    assert sorted((r.doc_id, r.pos, r.dl) for r in got) == sorted((i, p, len(t)) for i, t in rows if t for p in range(len(t)))
    # Each worker loads its encoder once, however many tasks it serves.
    assert len({tuple(r.vec) for r in got}) == len({r.vec[1] for r in got})


def test_encoder_factory_refuses_a_wrong_number_of_vectors(spark):
    tokens = spark.createDataFrame([(0, ["a", "b"])], "doc_id bigint, tokens array<string>")
    with pytest.raises(Exception, match="one vector per token"):
        encoders.encode_tokens_with(tokens, lambda: lambda lists: [np.zeros((1, 2)) for _ in lists]).collect()
