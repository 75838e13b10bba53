"""Neighbours, pooling and clustering against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexidra.operators import clustering, encoders, neighbors, pooling
from lexidra.operators.lexical import doc_tokens
from lexidra.operators.postings import topk_activation, zero_small
from lexidra.operators.search import token_bag_search
from lexidra.plans import dictionary as method
from registry import dictionary as registered

RNG = np.random.default_rng(3)


def frame(spark, name, matrix, ids=None):
    ids = range(len(matrix)) if ids is None else ids
    kind = "string" if isinstance(list(ids)[0], str) else "bigint"
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in zip(ids, matrix)], f"{name} {kind}, vec array<double>")


def brute(q, x, ids, k, metric):
    cost = ((q[:, None, :] - x[None]) ** 2).sum(-1) if metric == "l2" else -(q @ x.T)
    cost = np.floor(cost * 1e9 + 0.5) / 1e9 if metric == "l2" else -np.floor(-cost * 1e9 + 0.5) / 1e9
    return {(i, ids[j], r + 1) for i in range(len(q)) for r, j in enumerate(sorted(range(len(x)), key=lambda j: (cost[i, j], ids[j]))[:k])}


def triples(df):
    return {(r.query_id, r.item_id, r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def data():
    centres = RNG.normal(size=(12, 6)) * 3
    x = centres[RNG.integers(0, 12, 700)] + RNG.normal(size=(700, 6))
    x[::3] = x[0]  # one vector makes up a third of the items
    q = centres[RNG.integers(0, 12, 60)] + RNG.normal(size=(60, 6))
    return np.round(q, 3), np.round(x, 3)


@pytest.mark.parametrize("metric", ["l2", "dot"])
@pytest.mark.parametrize("plan", ["items", "queries", "grid", "cells"])
def test_exact_plans_equal_brute_force(spark, data, metric, plan, monkeypatch):
    q, x = data
    queries, items = frame(spark, "query_id", q), frame(spark, "item_id", x)
    want = brute(q, x, list(range(len(x))), 7, metric)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 64)
    if plan == "items":
        got = neighbors.nearest(queries, items, 7, metric)
    elif plan == "queries":
        got = neighbors.nearest(queries, items, 7, metric, ship_bytes=200 * 48)
    else:
        ship, slices = (59 * 48, 100) if plan == "grid" else (48, 0)
        got = neighbors.nearest(queries, items, 7, metric, ship_bytes=ship, cells=16, max_slices=slices)
    assert triples(got) == want


def test_string_ids_and_fewer_items_than_k(spark, data):
    q, x = data
    ids = [f"t{i:03d}" for i in range(5)]
    got = neighbors.nearest(frame(spark, "query_id", q), frame(spark, "item_id", x[:5], ids), 8)
    assert triples(got) == brute(q, x[:5], ids, 8, "l2")


def test_approximate_search_finds_most(spark, data):
    q, x = data
    want = {t[:2] for t in brute(q, x, list(range(len(x))), 5, "l2")}
    got = neighbors.nearest_by_cells(frame(spark, "query_id", q), frame(spark, "item_id", x), 5, cells=16, probes=6)
    found = {t[:2] for t in triples(got)}
    assert len(found & want) / len(want) > 0.8
    assert got.groupBy("query_id").count().where("count <> 5").isEmpty()


def test_assign_cluster_appends_one_hot(spark):
    vectors = frame(spark, "vec_id", np.array([[0.0, 0.0], [5.0, 5.0]]))
    centroids = frame(spark, "cluster", np.array([[9.0, 9.0], [0.1, 0.0], [5.0, 4.0]]))
    rows = {r.vec_id: (r.label, r.vec_with_label) for r in neighbors.assign_cluster(vectors, centroids).collect()}
    assert rows == {0: (1, [0.0, 0.0, 0.0, 1.0, 0.0]), 1: (2, [5.0, 5.0, 0.0, 0.0, 1.0])}


def texts(spark):
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    rows = [(i, " ".join(words[j] for j in RNG.integers(0, 7, 5 + 3 * i))) for i in range(12)]
    return spark.createDataFrame(rows + [(99, "")], "doc_id bigint, text string")


@pytest.fixture(scope="module")
def token_vecs(spark):
    return method.text_token_vectors(texts(spark)).persist()


def collected(token_vecs):
    return [(r.doc_id, r.pos, r.token, np.array(r.vec)) for r in token_vecs.orderBy("doc_id", "pos").collect()]


def test_dictionary_equals_plain_lloyd(spark, token_vecs):
    import hashlib

    rows = collected(token_vecs)
    want = {}
    for token in {r[2] for r in rows}:
        points = {}
        for doc, pos, t, vec in rows:
            if t == token:
                key = int(hashlib.md5(f"{doc}:{pos}".encode()).hexdigest()[:15], 16)
                n, least = points.get(tuple(vec), (0, key))
                points[tuple(vec)] = (n + 1, min(least, key))
        ordered = sorted(points, key=lambda v: points[v][1])
        centres = [np.array(v) for v in ordered[:3]]
        for _ in range(4 if len(ordered) > 3 else 0):
            groups = {}
            for v in ordered:
                gaps = [((np.array(v) - c) ** 2).sum() for c in centres]
                groups.setdefault(int(np.argmin(gaps)), []).append(v)
            for j, members in groups.items():
                n = sum(points[v][0] for v in members)
                mean = sum(np.array(v) * points[v][0] for v in members) / n
                centres[j] = np.floor(mean * 2**20 + 0.5) / 2**20
        for j, c in enumerate(centres):
            want[f"{token}_{j}"] = tuple(c)
    got = clustering.train_vector_dictionary(token_vecs, encoders.HASH_DIM, k=3, iterations=4, seeding="hash")
    assert {r.term: tuple(r.vec) for r in got.collect()} == want


@pytest.mark.parametrize("seeding", ["distance", "hash"])
@pytest.mark.parametrize("iterations", [2, None])
def test_dictionary_of_many_blocks_is_the_same(spark, token_vecs, monkeypatch, seeding, iterations):
    plain = clustering.train_vector_dictionary(token_vecs, encoders.HASH_DIM, k=3, iterations=iterations, seeding=seeding)
    want = {r.term: tuple(r.vec) for r in plain.collect()}
    monkeypatch.setattr(clustering, "BLOCK_POINTS", 5)
    monkeypatch.setattr(clustering, "LOCAL_BYTES", 8 * encoders.HASH_DIM * 12)
    blocked = clustering.train_vector_dictionary(token_vecs, encoders.HASH_DIM, k=3, iterations=iterations, seeding=seeding)
    assert {r.term: tuple(r.vec) for r in blocked.collect()} == want


def test_rounds_of_shipped_centroids_store_nothing(spark, token_vecs, monkeypatch):
    """Shipped and joined centroids end the same; only the joined ones are stored once a round."""
    monkeypatch.setattr(clustering, "BLOCK_POINTS", 5)
    monkeypatch.setattr(clustering, "LOCAL_BYTES", 8 * encoders.HASH_DIM * 12)
    plain, found, stored = clustering.cut_lineage, [], []
    for bound in (clustering.SHIP_BYTES, 1):
        calls = []
        monkeypatch.setattr(clustering, "SHIP_BYTES", bound)
        monkeypatch.setattr(clustering, "cut_lineage", lambda df, calls=calls: calls.append(1) or plain(df))
        entries = clustering.train_vector_dictionary(token_vecs, encoders.HASH_DIM, k=3)
        found.append({r.term: tuple(r.vec) for r in entries.collect()})
        stored.append(len(calls))
    # The names of large tokens, and three seeds.
    assert found[0] == found[1] and stored[0] == 4 < stored[1]


def plain_rounds(points, counts, centres):
    """Lloyd rounds without bounds, until nothing moves."""
    while True:
        nearest = ((points[:, None] - centres[None]) ** 2).sum(-1).argmin(axis=1)
        moved = centres.copy()
        for j in set(nearest.tolist()):
            mine = nearest == j
            moved[j] = np.floor((points[mine] * counts[mine, None]).sum(0) / counts[mine].sum() * 2**20 + 0.5) / 2**20
        if (moved == centres).all():
            return centres
        centres = moved


@pytest.mark.parametrize("clusters", [1, 2, 7])
def test_bounded_rounds_equal_plain_rounds(clusters):
    rng = np.random.default_rng(clusters)
    points = np.unique(np.round(rng.normal(size=(3000, 4)) * 64) / 64, axis=0)
    counts = rng.integers(1, 50, len(points))
    seeds = points[rng.choice(len(points), clusters, replace=False)]
    got = clustering._settled(points, counts, seeds, 300)
    assert (got == plain_rounds(points, counts, seeds)).all()


def test_seeds_are_drawn_by_weight_and_distance():
    rng = np.random.default_rng(1)
    vecs, counts = np.array([[0.0], [1.0], [3.0]]), np.array([5, 4, 1])
    second = np.zeros(3)
    for _ in range(20000):
        keys = rng.integers(0, 1 << 60, 3)
        gaps = clustering._gaps(vecs, vecs[:1])
        second[clustering._best_point(gaps, counts, keys, 1, "distance")[1]] += 1
    assert second[0] == 0  # already a seed
    assert abs(second[1] / 20000 - 4 / 13) < 0.02  # 4 copies at distance 1, one at squared distance 9


def inertia(token_vecs, dictionary):
    near = token_vecs.select("token", "doc_id", "pos", F.col("vec").alias("v")).join(dictionary, "token")
    gap = F.aggregate(F.zip_with("v", "vec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)
    least = near.groupBy("token", "doc_id", "pos").agg(F.min(gap).alias("gap"))
    return least.agg(F.sum("gap")).first()[0]


def test_weighted_seeds_find_separate_groups(spark):
    """Six far groups, one of them with most points: hash seeds mostly fall into that one."""
    rng = np.random.default_rng(8)
    rows = []
    for token in range(12):
        sizes = [400, 4, 4, 4, 4, 4]
        centres = rng.normal(size=(6, 4)) * 40
        for centre, size in zip(centres, sizes):
            rows += [(f"t{token}", len(rows) + i, 0, [float(x) for x in np.round((centre + rng.normal(size=4)) * 64) / 64]) for i in range(size)]
    vecs = spark.createDataFrame(rows, "token string, doc_id bigint, pos bigint, vec array<double>")
    costs = [inertia(vecs, clustering.train_vector_dictionary(vecs, 4, k=6, seeding=s)) for s in ("distance", "hash")]
    assert costs[0] < costs[1] / 4
    assert costs[0] < 12 * 420 * 4 * 1.5  # about the variance inside the groups


def test_dictionary_of_nothing_and_of_copies(spark):
    kind = "token string, doc_id bigint, pos bigint, vec array<double>"
    assert clustering.train_vector_dictionary(spark.createDataFrame([], kind), 2).isEmpty()
    copies = spark.createDataFrame([("a", i, 0, [1.0, 0.1]) for i in range(50)], kind)
    assert [(r.term, r.vec) for r in clustering.train_vector_dictionary(copies, 2, k=3).collect()] == [("a_0", [1.0, 0.1])]
    with pytest.raises(ValueError):
        clustering.train_vector_dictionary(copies, 2, seeding="other")


def test_dictionary_converges(spark, token_vecs):
    done = clustering.train_vector_dictionary(token_vecs, encoders.HASH_DIM, k=2)
    more = clustering.train_vector_dictionary(token_vecs, encoders.HASH_DIM, k=2, iterations=40)
    assert {(r.term, tuple(r.vec)) for r in done.collect()} == {(r.term, tuple(r.vec)) for r in more.collect()}


@pytest.mark.parametrize("block", [1024, 4])
def test_maxsim_index_equals_brute_force(spark, token_vecs, block, monkeypatch):
    monkeypatch.setattr(pooling, "BLOCK_POSITIONS", block)
    entries = clustering.train_vector_dictionary(token_vecs, encoders.HASH_DIM, k=3, iterations=2)
    names, c = zip(*sorted((r.term, np.array(r.vec)) for r in entries.collect()))
    c = np.array(c)
    want = {}
    rows = collected(token_vecs)
    for doc in {r[0] for r in rows}:
        v = np.array([r[3] for r in rows if r[0] == doc])
        cost = ((v[:, None] - c[None]) ** 2).sum(-1)
        terms = {j for i in range(len(v)) for j in sorted(range(len(c)), key=lambda j: (cost[i, j], names[j]))[:4]}
        want.update({(doc, names[j]): (v @ c[j]).max() for j in terms})
    got = {(r.doc_id, r.term): r.weight for r in method.index_documents(token_vecs, entries, n=4).collect()}
    assert got == want
    kept = method.index_documents(token_vecs, entries, n=4, threshold=0.3)
    assert {(r.doc_id, r.term) for r in kept.collect()} == {key for key, w in want.items() if w >= 0.3}


def test_sparta_with_and_without_slices(spark, token_vecs):
    vocabulary = encoders.hash_static_vectors(spark.createDataFrame([(w,) for w in "alpha beta x y z".split()], "term string"))
    rows = collected(token_vecs)
    vocab = {r.term: np.array(r.vec) for r in vocabulary.collect()}
    want = {}
    for doc in {r[0] for r in rows}:
        v = np.array([r[3] for r in rows if r[0] == doc])
        best = sorted(((-max(v @ x), t) for t, x in vocab.items()))[:2]
        want.update({(doc, t): np.log1p(-s) for s, t in best if s < 0})
    for limit in (1 << 20, 170):
        got = pooling.sparta_pooling(token_vecs, vocabulary, 2, ship_bytes=limit)
        found = {(r.doc_id, r.term): r.weight for r in got.collect()}
        assert found.keys() == want.keys()
        assert all(found[key] == pytest.approx(want[key], abs=1e-8) for key in want)


@pytest.mark.parametrize("ship", [1 << 20, 200])
@pytest.mark.parametrize("k", [1, 7, 60, 400])
def test_sparta_equals_brute_force(spark, k, ship, monkeypatch):
    monkeypatch.setattr(pooling, "BLOCK_POSITIONS", 5)
    monkeypatch.setattr(pooling, "TERM_STEP", 16)
    monkeypatch.setattr(pooling, "PIVOTS", 9)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 4)) * 3
    x = np.round(centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 4)) / 4, 3)
    x[::3] = x[0]  # one vector is that of a third of all terms
    vocabulary = spark.createDataFrame([(f"t{i:03d}", v.tolist()) for i, v in enumerate(x)], "term string, vec array<double>")
    lengths = {0: 1, 1: 23, 2: 60, 3: 4}
    texts = {d: np.round(centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 4)), 3) for d, n in lengths.items()}
    texts[3][:] = 0.0
    rows = [(d, len(v), p, row.tolist()) for d, v in texts.items() for p, row in enumerate(v)]
    token_vecs = spark.createDataFrame(rows, "doc_id bigint, dl bigint, pos bigint, vec array<double>")
    want = {}
    for d, v in texts.items():
        best = sorted((-s, f"t{i:03d}") for i, s in enumerate(np.floor((v @ x.T).max(axis=0) * 1e9 + 0.5) / 1e9) if s > 0)[:k]
        want.update({(d, t): np.log1p(-s) for s, t in best})
    found = {(r.doc_id, r.term): r.weight for r in pooling.sparta_pooling(token_vecs, vocabulary, k, ship_bytes=ship).collect()}
    assert found.keys() == want.keys()
    assert all(found[key] == pytest.approx(want[key], abs=1e-8) for key in want)


@pytest.mark.parametrize("k", [1, 7, 20])
def test_few_positions_go_to_a_large_vocabulary(spark, k, monkeypatch):
    """No pair of a document and a term is joined, and a task brings its best terms only."""
    monkeypatch.setattr(pooling, "BLOCK_POSITIONS", 5)
    monkeypatch.setattr(pooling, "VOCABULARY_STEP", 16, raising=False)
    monkeypatch.setattr(pooling, "_best_joined", lambda *args: pytest.fail("joined"))
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(900, 4)), 1)
    vocabulary = spark.createDataFrame([(f"t{i:03d}", v.tolist()) for i, v in enumerate(x)], "term string, vec array<double>")
    texts = {d: np.round(rng.normal(size=(n, 4)), 1) for d, n in {0: 1, 5: 23, 2: 12, 3: 4}.items()}
    texts[3][:] = 0.0
    rows = [(d, len(v), p, row.tolist()) for d, v in texts.items() for p, row in enumerate(v)]
    token_vecs = spark.createDataFrame(rows, "doc_id bigint, dl bigint, pos bigint, vec array<double>")
    want = {}
    for d, v in texts.items():
        best = sorted((-s, f"t{i:03d}") for i, s in enumerate(np.floor((v @ x.T).max(axis=0) * 1e9 + 0.5) / 1e9) if s > 0)[:k]
        want.update({(d, t): np.log1p(-s) for s, t in best})
    got = pooling.sparta_pooling(token_vecs, vocabulary.repartition(3), k, ship_bytes=20_000)
    found = {(r.doc_id, r.term): r.weight for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(found[key] == pytest.approx(want[key], abs=1e-8) for key in want)


def test_tiles_leave_most_terms_out(monkeypatch):
    monkeypatch.setattr(pooling, "TERM_STEP", 256)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 8)) * 4
    x = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 8)) / 8
    v = centres[:3] + rng.normal(size=(3, 8))
    rows, scores, visited = pooling.TermTiles(x).best(v, 20)
    exact = np.floor((v @ x.T).max(axis=0) * 1e9 + 0.5) / 1e9
    assert set(rows) == set(np.flatnonzero(exact >= np.sort(exact)[-20]))
    assert visited < len(x) / 5


def test_splade_and_mean_pooling(spark):
    logits = spark.createDataFrame(
        [(0, 0, "a", 1.0, 1), (0, 1, "a", 3.0, 0), (0, 1, "b", -2.0, 1), (1, 0, "a", 2.0, 1)],
        "doc_id int, pos int, term string, logit double, mask int",
    )
    rows = {(r.doc_id, r.term): r.weight for r in pooling.splade_pooling(logits).collect()}
    assert rows == {(0, "a"): pytest.approx(np.log(2)), (1, "a"): pytest.approx(np.log(3))}
    vecs = spark.createDataFrame([(0, [1.0, 2.0], 1), (0, [3.0, 6.0], 1), (0, [100.0, 100.0], 0)], "doc_id int, vec array<double>, mask int")
    docs = spark.createDataFrame([(0,), (7,)], "doc_id int")
    pooled = pooling.mean_pooling(vecs, 2, docs, F.col("mask"))
    assert {r.doc_id: r.vec for r in pooled.collect()} == {0: [2.0, 4.0], 7: [0.0, 0.0]}


def test_plugged_in_encoders(spark):
    docs = texts(spark)

    def by_length(lists):
        return [np.array([[len(t), i] for i, t in enumerate(tokens)], dtype=float).reshape(-1, 2) for tokens in lists]

    rows = encoders.encode_tokens(doc_tokens(docs), by_length)
    assert all(r.vec == [float(len(r.token)), float(r.pos)] for r in rows.collect())
    dense = encoders.encode_texts(docs, lambda batch: np.array([[len(t), 1.0] for t in batch]))
    lengths = {r.doc_id: float(len(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.vec[0] for r in dense.collect()} == lengths


def layers(spark, w, b):
    weights = [(i, j, float(w[i, j])) for i in range(w.shape[0]) for j in range(w.shape[1])]
    return (
        spark.createDataFrame(weights, "out bigint, inp bigint, w double"),
        spark.createDataFrame([(i, float(x)) for i, x in enumerate(b)], "out bigint, b double"),
    )


@pytest.mark.parametrize("kind", ["none", "lrelu", "xtanh", "sigmoid"])
def test_layers_shipped_and_joined(spark, kind, monkeypatch):
    x, w0, b0, w1, b1 = RNG.normal(size=(9, 4)), RNG.normal(size=(5, 4)), RNG.normal(size=5), RNG.normal(size=(3, 5)), RNG.normal(size=3)
    h = x @ w0.T + b0
    act = {"none": h, "lrelu": np.where(h > 0, h, 0.2 * h), "xtanh": np.tanh(h) + 0.2 * h, "sigmoid": 1 / (1 + np.exp(-h))}[kind]
    want = act @ w1.T + b1
    chain = [layers(spark, w0, b0), layers(spark, w1, b1)]
    for small in (True, False):
        if not small:
            monkeypatch.setattr(encoders, "arrow_if_small", lambda *a, **k: None)
        got = encoders.mlp_score(frame(spark, "vec_id", x), chain, kind, 0.2)
        out = np.array([r.vec for r in got.orderBy("vec_id").collect()])
        assert np.allclose(out, want)
    with pytest.raises(ValueError):
        encoders.mlp_score(frame(spark, "vec_id", x), chain, "relu6")


def test_linear_autoencoder(spark, monkeypatch):
    x, w, pre, lat = RNG.normal(size=(6, 4)), RNG.normal(size=(8, 4)), RNG.normal(size=4), RNG.normal(size=8)
    weights = layers(spark, w, lat)[0].toDF("latent", "dim", "w")
    pre_bias = spark.createDataFrame([(i, float(b)) for i, b in enumerate(pre)], "dim bigint, b double")
    latent_bias = spark.createDataFrame([(i, float(b)) for i, b in enumerate(lat)], "latent bigint, b double")
    rows = frame(spark, "vec_id", x)
    z = (x - pre) @ w.T + lat
    encoded = encoders.linear_encode(rows, weights, pre_bias, latent_bias)
    assert np.allclose([r.vec for r in encoded.orderBy("vec_id").collect()], z)
    part = encoders.linear_encode(rows, weights, pre_bias, latent_bias, latents=(2, 5))
    assert np.allclose([r.vec for r in part.orderBy("vec_id").collect()], z[:, 2:5])
    sparse = topk_activation(encoded, 3, "vec_id", "vec")
    kept = np.zeros_like(z)
    for i, row in enumerate(z):
        for j in np.argsort(-row)[:3]:
            kept[i, j] = max(row[j], 0)
    found = np.zeros_like(z)
    for r in sparse.collect():
        found[r.vec_id, r.dim] = r.weight
    assert np.allclose(found, kept)
    info = rows.select("vec_id", F.lit(1.5).alias("mu"), F.lit(2.0).alias("std"))
    decoder = encoders.decoder_rows(weights)
    plain = encoders.linear_decode(sparse, decoder, pre_bias, rows, 4)
    assert np.allclose([r.vec for r in plain.orderBy("vec_id").collect()], kept @ w + pre)
    few = sparse.where("vec_id < 3")
    shipped = encoders.linear_decode(few, decoder, pre_bias, rows, 4).orderBy("vec_id").collect()
    scaled = encoders.linear_decode(sparse, decoder, pre_bias, rows, 4, info)
    assert np.allclose([r.vec for r in scaled.orderBy("vec_id").collect()], (kept @ w + pre) * 2.0 + 1.5)


    monkeypatch.setattr(encoders, "arrow_if_small", lambda *a, **k: None)
    joined = encoders.linear_decode(few, decoder, pre_bias, rows, 4).orderBy("vec_id").collect()
    assert np.allclose([r.vec for r in shipped], [r.vec for r in joined])
    assert np.allclose(joined[5].vec, pre)


def test_layer_norm_and_zeroing(spark):
    x = RNG.normal(size=(5, 7))
    rows = encoders.layer_norm(frame(spark, "vec_id", x)).orderBy("vec_id").collect()
    mu, std = x.mean(1), x.std(1, ddof=1)
    assert np.allclose([r.mu for r in rows], mu) and np.allclose([r["std"] for r in rows], std)
    assert np.allclose([r.vec for r in rows], (x - mu[:, None]) / (std[:, None] + 1e-5))
    lo, hi = np.quantile(x, [0.2, 0.8], axis=1)
    want = np.where((x <= lo[:, None]) | (x >= hi[:, None]), x, 0.0)
    kept = zero_small(frame(spark, "vec_id", x), 0.2, "quantile").orderBy("vec_id").collect()
    assert np.allclose([r.vec for r in kept], want)
    kept = zero_small(frame(spark, "vec_id", x), 0.5, "threshold").orderBy("vec_id").collect()
    assert np.allclose([r.vec for r in kept], np.where(np.abs(x) < 0.5, 0.0, x))
    with pytest.raises(ValueError):
        zero_small(frame(spark, "vec_id", x), 0.5, "other")


def test_gaussian_sample_is_repeatable(spark):
    rows = spark.range(20000).select(F.col("id").alias("vec_id"), F.lit(0).alias("dim"), F.lit(2.0).alias("mu"), F.lit(9.0).alias("v"))
    draws = encoders.gaussian_sample(rows, 1)
    again = encoders.gaussian_sample(rows.repartition(3), 1)
    assert draws.exceptAll(again).isEmpty()
    stats = draws.agg(F.avg("z").alias("m"), F.stddev("z").alias("s")).first()
    assert abs(stats.m - 2.0) < 0.1 and abs(stats.s - 3.0) < 0.1


def test_elbow_falls(spark):
    x = np.vstack([RNG.normal(size=(60, 3)) + 8 * c for c in range(4)])
    curve = [r.inertia for r in clustering.elbow_curve(frame(spark, "vec_id", x), (2, 4, 12)).orderBy("k").collect()]
    assert curve[0] > curve[1] > curve[2]
    assert clustering.global_kmeans(frame(spark, "vec_id", x), 4).count() == 4


def plain_chain(points, keys, k):
    """Seeds drawn one after the other over all points."""
    seeds = np.empty((0, points.shape[1]))
    while len(seeds) < k:
        cost, best = clustering._best_point(clustering._gaps(points, seeds), np.ones(len(points)), keys, len(seeds), "distance")
        if not np.isfinite(cost):
            break
        seeds = np.vstack([seeds, points[best]])
    return seeds


@pytest.mark.parametrize("ahead,candidates", [(16, 64), (16, 3), (1, 1), (5, 1)])
def test_models_equal_plain_kmeans(spark, monkeypatch, ahead, candidates):
    import hashlib

    monkeypatch.setattr(clustering, "SEEDS_AHEAD", ahead)
    monkeypatch.setattr(clustering, "SEED_CANDIDATES", candidates)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 3)) * 64) / 64
    x[::4] = x[0]  # a quarter are copies of one vector
    keys = np.array([int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:15], 16) for i in range(len(x))])
    models, inertia = clustering.kmeans_models(frame(spark, "vec_id", x).repartition(5), (1, 4, 9), None, 7, "vec", "vec_id")
    seeds = plain_chain(x, keys, 9)
    for k in (1, 4, 9):
        want = plain_rounds(x, np.ones(len(x), dtype=int), seeds[:k])
        assert (models[k] == want).all()
        assert inertia[k] == pytest.approx(((x[:, None] - want[None]) ** 2).sum(-1).min(1).sum())


def test_models_of_few_vectors(spark):
    kind = "vec_id bigint, vec array<double>"
    assert clustering.global_kmeans(spark.createDataFrame([], kind), 4).isEmpty()
    assert clustering.elbow_curve(spark.createDataFrame([(1, None)], kind), (2, 3)).isEmpty()
    few = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(30)] + [(99, None)], kind)
    assert sorted(r.vec for r in clustering.global_kmeans(few, 8).collect()) == [[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]]
    assert [r.inertia for r in clustering.elbow_curve(few, (3, 8)).orderBy("k").collect()] == [0.0, 0.0]
    with pytest.raises(ValueError):
        clustering.global_kmeans(few, 10**8)


def test_latents_are_not_sent_through_the_driver(spark):
    docs = spark.range(20).select(F.col("id").alias("vec_id"))
    latents = docs.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(599))).alias("dim"), F.lit(1.0).alias("weight"))
    decoder = spark.range(600).select(F.col("id").alias("latent"), F.array(F.lit(0.5), F.lit(2.0)).alias("vec"))
    bias = spark.createDataFrame([(0, 1.0), (1, -1.0)], "dim bigint, b double")
    decoded = encoders.linear_decode(latents, decoder, bias, docs, 2)
    assert "BroadcastHashJoin" not in decoded._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r.vec) for r in decoded.collect()} == {(301.0, 1199.0)} and decoded.count() == 20


@pytest.mark.parametrize("rows", ["7", "10000"])
def test_sparta_of_whole_documents_shuffles_nothing(spark, monkeypatch, rows):
    monkeypatch.setattr(pooling, "BLOCK_POSITIONS", 5)
    monkeypatch.setattr(pooling, "TERM_STEP", 16)
    words = [f"w{i}" for i in range(60)]
    texts = [(d, " ".join(words[(d * j + j * j) % 60] for j in range(n))) for d, n in enumerate((1, 23, 60, 0, 4))]
    docs = spark.createDataFrame([*texts, (9, None), (None, "w1 w2")], "doc_id long, text string").repartition(2)
    token_vecs = method.text_token_vectors(docs)
    vocabulary = encoders.hash_static_vectors(spark.createDataFrame([(w,) for w in words], "term string")).cache()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        for k in (1, 7, 100):
            got = pooling.sparta_pooling(token_vecs, vocabulary, k, whole=True)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow")[0] and "collect_list" not in plan
            want = sorted(map(str, pooling.sparta_pooling(token_vecs, vocabulary, k).collect()))
            assert sorted(map(str, got.collect())) == want and want
            tokens = spark.createDataFrame([(0, "w1"), (0, "w1"), (0, "w5"), (1, "w50")], "query_id long, token string")
            found = [sorted(map(str, token_bag_search(tokens, got, 3, whole).collect())) for whole in (True, False)]
            assert found[0] == found[1] and found[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_digest_lanes_hold_the_bytes_of_md5(spark):
    words = ["", "a", "0", "ünï", "word", "x" * 300, *(f"w{i}" for i in range(500))]
    rows = spark.createDataFrame([(w,) for w in words], "term string")
    got = {r.term: r.lanes for r in rows.select("term", encoders._digest_lanes(F.col("term")).alias("lanes")).collect()}
    for w in words:
        digest = hashlib.md5(w.encode()).digest()
        assert got[w] == [int.from_bytes(b"".join(bytes([0, x]) for x in digest[4 * j : 4 * j + 4]), "big") for j in range(4)]
    plan = rows.select(encoders._digest_lanes(F.col("term")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_the_plugged_in_encoder_looks_up_many_tokens_at_once(monkeypatch):
    """One lookup a step, not one array a token, also when the known tokens are forgotten inside a document."""
    monkeypatch.setattr(registered, "KNOWN_TOKENS", 40)
    monkeypatch.setattr(registered, "ENCODE_STEP", 7)
    monkeypatch.setattr(registered.np, "vstack", None)
    tokens = [f"w{i * i % 97}" for i in range(300)]
    (got,) = registered._load_hash_encoder()([tokens])
    own = np.array([list(hashlib.md5(t.encode()).digest()) for t in tokens]) - 128.0
    want = 4 * own
    for gap, weight in ((1, 2), (2, 1)):
        want[gap:] += weight * own[:-gap]
        want[:-gap] += weight * own[gap:]
    assert (got == want / 1024).all()


@pytest.mark.parametrize("ship", [1 << 20, 200])
def test_sparta_of_whole_documents_beside_a_large_vocabulary_shuffles_nothing(spark, monkeypatch, ship):
    """Also where the vocabulary is beyond the shipping bound, ties are many and documents go on in the next row."""
    for name, value in (("BLOCK_POSITIONS", 5), ("TERM_STEP", 16), ("PIVOTS", 9), ("HELD_VALUES", 28), ("HELD_DOCS", 2)):
        monkeypatch.setattr(pooling, name, value)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(300, 4)), 3)
    x[::3] = x[0]
    vocabulary = spark.createDataFrame([(f"t{i * 7 % 300:03d}", v.tolist()) for i, v in enumerate(x)], "term string, vec array<double>").cache()
    lengths = {0: 1, 1: 23, None: 9, 2: 60, 3: 1, 4: 1, 5: 1, 6: 4, 7: 2}
    rows = [(d, n, p, np.round(rng.normal(size=4), 3).tolist() if d != 6 else [0.0] * 4) for d, n in lengths.items() for p in range(n)]
    token_vecs = spark.createDataFrame(rows, "doc_id bigint, dl bigint, pos bigint, vec array<double>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for k in (1, 7, 60, 400):
            got = pooling.sparta_pooling(token_vecs, vocabulary, k, ship_bytes=ship, whole=True)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and ("CartesianProduct" in plan) == (ship == 200)
            want = {}
            for d in lengths:
                v = np.array([r[3] for r in rows if r[0] == d])
                scores = np.floor((v @ x.T).max(axis=0) * 1e9 + 0.5) / 1e9
                best = sorted((-s, f"t{i * 7 % 300:03d}") for i, s in enumerate(scores) if s > 0)[:k]
                want.update({(d, t): np.log1p(-s) for s, t in best})
            found = [(r.doc_id, r.term, r.weight) for r in got.collect()]
            assert {f[:2] for f in found} == want.keys() and len(found) == len(want)
            assert all(w == pytest.approx(want[d, t], abs=1e-8) for d, t, w in found)
            order = [f[0] for f in found]
            assert sum(a != b for a, b in zip(order, order[1:], strict=False)) == len(set(order)) - 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("rows", ["3", "10000"])
def test_splade_of_whole_documents_shuffles_nothing(spark, rows):
    entries = [(d, p, f"t{(d or 2) * p % 5}" if p % 11 else None, float((d or 1) * p % 13 - 4), p % 4) for d in (0, 3, None, 7) for p in range(30)]
    logits = spark.createDataFrame(entries, "doc_id long, pos long, term string, logit double, mask int").coalesce(1)
    asked = spark.createDataFrame([("t1",), ("t1",), ("t4",)], "term string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        want = pooling.splade_pooling(logits).collect()
        got = pooling.splade_pooling(logits, whole=True)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, got.collect())) == sorted(map(str, want))
        some = pooling.splade_pooling(logits, whole=True, asked=asked)
        assert sorted(map(str, some.collect())) == sorted(str(r) for r in want if r.term in ("t1", "t4"))
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert plan.index("MapInArrow") < plan.index("LeftSemi")
        every = pooling.splade_pooling(logits, whole=True, asked=asked, ship_bytes=64)
        assert len(every.collect()) == len(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
