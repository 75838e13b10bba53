"""The near-duplicate stage of the pipeline and the operator it stands on."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lexidra.llm import simhash


def test_near_stage_links_the_fingerprints_of_the_operator(spark, monkeypatch):
    base = " ".join(f"w{i * i % 97}x{i}" for i in range(300))
    rows = [(1, base), (2, base.replace("w1x1 ", "other ")), (3, " ".join(f"v{i}" for i in range(300))), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    linked = {r.fingerprint for r in simhash.simhash_components(docs).collect()}
    seen, plain = [], simhash.ball_pairs

    def watched(points, bits, radius, links, group_rows):
        if bits == simhash.BITS and radius == simhash.RADIUS:
            seen.append({f"{r.value % (1 << 64):016x}" for r in points.collect()})
        return plain(points, bits, radius, links, group_rows)

    monkeypatch.setattr(simhash, "ball_pairs", watched)
    kept = corpus_pipeline.near(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4}
    assert seen == [linked]


@pytest.mark.parametrize("rows", [8192, 40])
def test_pairs_that_meet_alone_stay_out_of_the_crowd(spark, rows):
    """Where two rows meet alone nothing is left to compare; among the others every pair is found."""
    rng, values = random.Random(rows), {}
    for _ in range(200):
        base = rng.getrandbits(32)
        for _ in range(rng.choice([1, 2, 2, 2, 6])):
            values[base ^ sum(1 << b for b in rng.sample(range(32), rng.randrange(3)))] = 1
    values = dict.fromkeys(values, 1) | {v: 2 for v in list(values)[::40]}
    points = spark.createDataFrame([(i, 3, v, n) for i, (v, n) in enumerate(values.items())], "node long, space int, value long, n long")
    met = simhash.ball_pairs(points, 32, 2, False, rows).collect()
    assert {r.crowd for r in met} == {-1, 3}
    crowd = {x for r in met if r.crowd == 3 for x in (r.a, r.b)}
    rooted = points.drop("n").where(F.col("node").isin(list(crowd))).withColumn("root", F.col("node"))
    late = simhash.ball_pairs(rooted, 32, 2, False, rows).collect()
    at = list(values)
    near = {(i, j) for j in range(len(at)) for i in range(j) if (at[i] ^ at[j]).bit_count() <= 2}
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in [*met, *late]} == near
    alone = {(min(r.a, r.b), max(r.a, r.b)) for r in met if not {r.a, r.b} & crowd}
    assert len(alone) > 50 and all(values[at[i]] + values[at[j]] == 2 for i, j in alone)


def test_all_fingerprints_that_the_operator_links_are_compared(spark):
    """Texts with one repeated block share their whole fingerprint; pairs of them are found beside the one that links all."""
    rng = random.Random(11)
    block = " ".join(["the same few words again and over"] * 300)
    rows = []
    for i in range(60):
        tail = [f"t{i}x{j}" for j in range(rng.randrange(110, 140))]
        other = tail[:]
        other[len(tail) // 3] = other[2 * len(tail) // 3] = "changed"
        rows += [(2 * i, f"{block} {' '.join(tail)}"), (2 * i + 1, f"{block} {' '.join(other)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({r.component_id for r in simhash.simhash_components(docs).collect()}) == 1
    plain = simhash.SPACES
    try:
        # So that halves find nearly nothing: what is left are the links of the operator.
        simhash.SPACES = 1
        kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()}
    finally:
        simhash.SPACES = plain
    assert kept == set(range(0, 120, 2))


def test_pairs_of_short_texts_are_verified(spark):
    """Four of five shingles in common: the fingerprints alone put many of these pairs below 0.7."""
    rows = []
    for i in range(100):
        words = [f"w{i}x{j}" for j in range(9)]
        rows += [(2 * i, " ".join(words[:8])), (2 * i + 1, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = [f"f{c}" for c in range(simhash.COPIES)]
    found = simhash.fingerprints(docs, simhash.NEAR_SHINGLE, simhash.COPIES, docs.columns, distinct=True).withColumn("row_id", F.col("doc_id"))
    nodes = found.select(F.col("doc_id").alias("node"), *names, F.struct("row_id").alias("best"))
    pairs = spark.range(100).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b"))
    assert simhash._verified(pairs, nodes, found, names, simhash.SIMILARITY).count() == 100


@pytest.mark.parametrize("rows", [8192, 50])
def test_whole_fingerprints_of_different_roots_meet(spark, rows):
    """All pairs within three bits, however the groups are cut, and none of one root."""
    rng, values = random.Random(rows), []
    for _ in range(30):
        base = rng.getrandbits(64)
        values += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(5)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    points = spark.createDataFrame([(i, 0, v, i // 2) for i, v in enumerate(signed)], "node long, space int, value long, root long")
    met = simhash.ball_pairs(points, simhash.BITS, simhash.RADIUS, False, rows).collect()
    near = {(i, j) for j in range(len(values)) for i in range(j) if i // 2 != j // 2 and (values[i] ^ values[j]).bit_count() <= 3}
    assert len(near) > 50 and {(r.a, r.b) for r in met} == near
