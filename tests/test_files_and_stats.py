"""Files, index store, evaluation and statistics."""

from __future__ import annotations

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexidra.operators import evaluation, lexical, stats
from lexidra.operators.postings import duplicate_postings, index_stats
from lexidra.session import arrow_if_small, cut_lineage, shared_dir
from lexidra.sources import corpus as C
from lexidra.sources import index_store as I
from lexidra.sources import runs as R
from lexidra.sources import term_statistics
from lexidra.streaming.append import append_stream, statistics_stream

POSTING = "term string, doc_id bigint, weight double"


def docs(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "doc_id bigint")


def test_corpus_files(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"_id": "a", "title": "T", "text": "x \\n"}\n{"_id": "b", "text": "y"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q", "text": "x?", "metadata": {}}\n')
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels" / "dev.tsv").write_text("query-id\tcorpus-id\tscore\nq\ta\t2\n")
    rows = C.with_full_text(C.read_corpus(spark, str(tmp_path / "corpus.jsonl")))
    assert {r.doc_id: r.contents for r in rows.collect()} == {"a": "T x", "b": "y"}
    assert C.read_queries(spark, str(tmp_path / "queries.jsonl")).first().asDict() == {"query_id": "q", "text": "x?"}
    assert C.read_qrels(spark, str(tmp_path / "qrels"), "dev").first().asDict() == {"query_id": "q", "doc_id": "a", "rel": 2}
    with pytest.raises(ValueError):
        C.read_qrels(spark, str(tmp_path), "all")


@pytest.mark.parametrize("text", ["\u00a0x\u3000", "\x1cx\x85", " \t\nx\r\x0b\x0c", "x\u200b", "\u2028 x y \u2029"])
def test_trimming_equals_python(spark, text):
    row = C.with_full_text(spark.createDataFrame([("", text)], "title string, text string")).first()
    assert row.contents == (" " + text).strip()


def test_truncation_keeps_judged_queries(spark):
    corpus = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "doc_id bigint, text string")
    queries = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "query_id int, text string")
    qrels = spark.createDataFrame([(0, 1, 1), (0, 9, 1), (1, 9, 1), (2, 2, 0)], "query_id int, doc_id bigint, rel int")
    kept, asked, judged = C.truncate_with_judgments(corpus, queries, qrels, 4)
    assert {r.doc_id for r in kept.collect()} == {0, 1, 2, 3}
    assert {r.query_id for r in asked.collect()} == {0, 2}
    assert {(r.query_id, r.doc_id) for r in judged.collect()} == {(0, 1), (2, 2)}
    assert C.truncate_with_judgments(corpus, queries, qrels, None)[0] is corpus
    with pytest.raises(ValueError):
        C.truncate_corpus(corpus, 0)


def test_first_lines_of_a_split_file(spark, tmp_path):
    lines = [f'{{"_id": "d{(i * 7919) % 3000}", "title": "", "text": "{"x" * (i % 40)}"}}' for i in range(3000)]
    (tmp_path / "corpus.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        corpus = C.read_corpus(spark, str(tmp_path / "corpus.jsonl"), with_line_order=True)
        assert corpus.rdd.getNumPartitions() > 4
        kept = C.truncate_corpus(corpus, 700, "line_order")
        assert {r.doc_id for r in kept.collect()} == {f"d{(i * 7919) % 3000}" for i in range(700)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_copies_keep_the_first(spark):
    corpus = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (9, "x")], "doc_id bigint, text string")
    assert {r.doc_id for r in C.dedup_corpus(corpus).collect()} == {1, 2}


def test_run_files(spark, tmp_path):
    run = spark.createDataFrame([(0, 5, 1.5), (0, 6, 0.25), (1, 5, -2.0)], "query_id int, doc_id bigint, score double")
    R.write_run(run, str(tmp_path / "run"))
    back = {(r.query_id, r.doc_id, r.score) for r in R.read_run(spark, str(tmp_path / "run")).collect()}
    assert back == {("0", "5", 1.5), ("0", "6", 0.25), ("1", "5", -2.0)}
    (tmp_path / "whole.json").write_text('{"q1": {"d1": 1, "d2": 0.5}, "q2": {"d1": 3}}')
    assert R.read_run(spark, str(tmp_path / "whole.json")).count() == 3


@pytest.mark.parametrize("indent", [None, 1])
def test_one_object_of_all_queries_is_many_tasks(spark, tmp_path, indent):
    run = {f'q "{i}\\\\': {f"d{j}": (i * j) / 8 for j in range(i % 5)} for i in range(400)}
    text = json.dumps(run, indent=indent)
    (tmp_path / "run.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = R.read_run(spark, str(tmp_path / "run.json"))
        found = [(r.query_id, r.doc_id, r.score) for r in rows.collect()]
        tasks = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(found) == sorted((q, d, s) for q, hits in run.items() for d, s in hits.items())
    assert tasks > 3


def test_run_files_with_braces_and_errors(spark, tmp_path):
    run = {"a}": {"}": 1.0, "x": 2.0}, "{b": {"c": 0.5}, "none": {}}
    (tmp_path / "braces.json").write_text(json.dumps(run))
    found = {(r.query_id, r.doc_id, r.score) for r in R.read_run(spark, str(tmp_path / "braces.json")).collect()}
    assert found == {("a}", "}", 1.0), ("a}", "x", 2.0), ("{b", "c", 0.5)}
    (tmp_path / "empty.json").write_text("{}\n")
    assert R.read_run(spark, str(tmp_path / "empty.json")).isEmpty()
    (tmp_path / "bad.json").write_text('{"q": {"d": "high"}}')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        R.read_run(spark, str(tmp_path / "bad.json")).collect()


def test_order_of_ties(spark):
    run = spark.createDataFrame([(0, d, 1.0) for d in range(1, 6)] + [(0, 9, 2.0)], "query_id bigint, doc_id bigint, score double")
    qrels = spark.createDataFrame([(0, 5, 1)], "query_id bigint, doc_id bigint, rel int")
    for ties, rank in (("ascending", 6), ("descending", 2)):
        rows = evaluation.evaluate_run(qrels, run, (1, 3, 10), "mrr", ties=ties).collect()
        assert {r.k: r.value for r in rows} == {k: round(1 / rank, 5) if k >= rank else 0.0 for k in (1, 3, 10)}
        hits = evaluation.judged_hits(run, qrels, 2, ties).orderBy("rank").collect()
        assert [r.doc_id for r in hits] == ([9, 1] if ties == "ascending" else [9, 5])
    with pytest.raises(ValueError):
        evaluation.evaluate_run(qrels, run, ties="random")


def test_index_generations(spark, tmp_path):
    root = str(tmp_path / "index")
    first = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0)], POSTING)
    assert I.current_generation(spark, root) is None
    with pytest.raises(FileNotFoundError):
        I.read_postings(spark, root)
    I.write_postings(first, docs(spark, 0, 1), root)
    assert I.append_documents(spark.createDataFrame([("a", 2, 3.0)], POSTING), docs(spark, 2), root) == 0
    late = spark.createDataFrame([("c", 3, 4.0)], POSTING)
    assert I.append_documents(late, docs(spark, 3), root, epoch=7) == 7
    assert I.append_documents(late, docs(spark, 3), root, epoch=7) == 7
    want = {("a", 0, 1.0), ("b", 0, 2.0), ("a", 2, 3.0), ("c", 3, 4.0)}

    def held():
        rows = [tuple(r) for r in I.read_postings(spark, root).collect()]
        assert len(rows) == len(set(rows))
        return set(rows)

    assert held() == want
    with pytest.raises(ValueError, match="already"):
        I.append_documents(late, docs(spark, 3), root, "other")
    assert I.compact(spark, root) == 1 and I.current_generation(spark, root) == 1
    assert held() == want
    I.append_documents(late, docs(spark, 3), root, epoch=7)  # a replay after the compaction
    assert held() == want
    assert I.append_documents(spark.createDataFrame([("c", 4, 1.0)], POSTING), docs(spark, 4), root) == 8
    assert held() == want | {("c", 4, 1.0)}
    assert I.compact(spark, root) == 2 and held() == want | {("c", 4, 1.0)}
    I.append_documents(late, docs(spark, 3), root, epoch=7)
    assert held() == want | {("c", 4, 1.0)}
    I.write_postings(first, docs(spark, 0, 1), root)
    assert held() == {("a", 0, 1.0), ("b", 0, 2.0)}


def test_index_without_a_build_and_half_appends(spark, tmp_path):
    root = str(tmp_path / "index")
    I.append_documents(spark.createDataFrame([("a", 2, 3.0)], POSTING), docs(spark, 2), root, "w", 5)
    # Appends that died: only documents, or postings without their marker.
    docs(spark, 8).write.parquet(f"{root}/batches/writer=w/epoch=6/docs")
    docs(spark, 9).write.parquet(f"{root}/batches/writer=w/epoch=7/docs")
    spark.createDataFrame([("z", 9, 1.0)], POSTING).write.parquet(f"{root}/batches/writer=w/epoch=7/postings")
    os.remove(f"{root}/batches/writer=w/epoch=7/postings/_SUCCESS")
    assert {tuple(r) for r in I.read_postings(spark, root).collect()} == {("a", 2, 3.0)}
    assert {r.doc_id for r in I.read_indexed_docs(spark, root).collect()} == {2}
    I.append_documents(spark.createDataFrame([("z", 9, 2.0)], POSTING), docs(spark, 9), root, "w", 7)
    assert I.compact(spark, root) == 0
    assert {tuple(r) for r in I.read_postings(spark, root).collect()} == {("a", 2, 3.0), ("z", 9, 2.0)}


def test_append_made_during_a_compaction_stays(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    I.write_postings(spark.createDataFrame([("a", 0, 1.0)], POSTING), docs(spark, 0), root)
    plain = I._write

    def meanwhile(postings, of, path):
        if "/base/" in path:
            monkeypatch.setattr(I, "_write", plain)
            I.append_documents(spark.createDataFrame([("b", 1, 1.0)], POSTING), docs(spark, 1), root)
        plain(postings, of, path)

    monkeypatch.setattr(I, "_write", meanwhile)
    I.compact(spark, root)
    assert {tuple(r) for r in I.read_postings(spark, root).collect()} == {("a", 0, 1.0), ("b", 1, 1.0)}


def test_index_stats(spark, tmp_path):
    root = str(tmp_path / "index")
    rows = [("a", 0, 1.0), ("b", 0, 2.0), ("a", 2, 3.0), ("c", 3, 4.0)]
    I.write_postings(spark.createDataFrame(rows, POSTING), docs(spark, 0, 1, 2, 3), root)
    row = index_stats(I.read_postings(spark, root), I.read_indexed_docs(spark, root)).first()
    assert (row.n_docs, row.n_terms, row.avg_list_length) == (4, 3, pytest.approx(4 / 3))


def test_double_postings_fail(spark, tmp_path):
    twice = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 2.0)], POSTING)
    assert duplicate_postings(twice).count() == 1
    with pytest.raises(Exception, match="more than once"):
        I.write_postings(twice, docs(spark, 0), str(tmp_path / "bad"))
    assert I.current_generation(spark, str(tmp_path / "bad")) is None


def test_reuse_or_rebuild(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return docs(spark, len(built))

    path = str(tmp_path / "artefact")
    assert I.reuse_or_rebuild(spark, path, build).first().doc_id == 1
    assert I.reuse_or_rebuild(spark, path, build).first().doc_id == 1
    assert I.reuse_or_rebuild(spark, path, build, use_cache=False).first().doc_id == 2


def test_stream_appends_once(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "index")
    rows = spark.createDataFrame([(0, "a b"), (1, "b")], "doc_id bigint, text string")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    I.write_postings(spark.createDataFrame([("old", 9, 1.0)], POSTING), docs(spark, 9), root)

    def to_postings(batch):
        words = batch.select("doc_id", F.explode(F.split("text", " ")).alias("term"))
        return words.select("term", "doc_id", F.lit(1.0).alias("weight"))

    def run(state):
        append_stream(stream, to_postings, root, str(tmp_path / state)).trigger(availableNow=True).start().awaitTermination()

    for _ in range(2):
        run("state")
    want = [("a", 0), ("b", 0), ("b", 1), ("old", 9)]
    assert sorted((r.term, r.doc_id) for r in I.read_postings(spark, root).collect()) == want
    with pytest.raises(Exception, match="already"):
        run("state of another stream")
    assert sorted((r.term, r.doc_id) for r in I.read_postings(spark, root).collect()) == want


def test_measures_by_hand(spark):
    qrels = spark.createDataFrame([("q1", "a", 2), ("q1", "b", 1), ("q1", "z", 0), ("q2", "c", 1), ("q3", "a", 1)], "query_id string, doc_id string, rel int")
    run = spark.createDataFrame(
        [("q1", "x", 9.0), ("q1", "b", 8.0), ("q1", "a", 7.0), ("q2", "q2", 9.0), ("q2", "c", 1.0), ("q4", "a", 1.0)],
        "query_id string, doc_id string, score double",
    )
    got = {(r.metric, r.k): r.value for r in evaluation.evaluate_run(qrels, run, (1, 3)).collect()}
    ideal = 2 + 1 / math.log2(3)
    dcg = 1 / math.log2(3) + 2 / 2
    assert got["ndcg", 1] == 0.5 and got["ndcg", 3] == pytest.approx((dcg / ideal + 1) / 2, abs=1e-5)
    assert got["map", 3] == pytest.approx(((0.5 + 2 / 3) / 2 + 1) / 2, abs=1e-5)
    assert got["recall", 1] == 0.5 and got["recall", 3] == 1.0
    assert got["precision", 3] == pytest.approx((2 / 3 + 1 / 3) / 2, abs=1e-5)
    assert got["mrr", 3] == pytest.approx((0.5 + 1 + 0) / 3, abs=1e-5)
    only = evaluation.evaluate_run(qrels, run, (1, 3), "mrr")
    assert {r.metric for r in only.collect()} == {"mrr"}
    with pytest.raises(ValueError):
        evaluation.evaluate_run(qrels, run, metric="accuracy")


def test_quantiles_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = np.round(rng.exponential(size=30000), 3)
    values[::3] = 0.25  # one value is a third of all samples
    rows = [("big", float(v)) for v in values] + [("small", 1.0), ("small", 4.0)]
    df = spark.createDataFrame(rows, "bench string, seconds double")
    monkeypatch.setattr(stats, "QUANTILE_ACCURACY", 500)
    got = {(r.bench, r.q): r.quantile for r in stats.exact_quantiles(df, "bench", "seconds", (0.0, 0.5, 0.9, 0.95, 1.0)).collect()}
    for q in (0.0, 0.5, 0.9, 0.95, 1.0):
        assert got["big", q] == pytest.approx(np.quantile(values, q))
        assert got["small", q] == pytest.approx(1.0 + 3.0 * q)


def test_latency_table(spark):
    df = spark.createDataFrame([("b", x) for x in (0.001, 0.002, 0.006)], "bench string, seconds double")
    row = stats.latency_stats(df).first()
    assert (row.n, row["mean"], row.p50) == (3, pytest.approx(3.0), pytest.approx(2.0))
    half = 1.959963984540054 * row["std"] / math.sqrt(3)
    assert row.ci_low == pytest.approx(3.0 - half) and row.ci_high == pytest.approx(3.0 + half)
    assert stats.latency_stats(df, confidence=1.0, unit="us").first().ci_high == math.inf
    for wrong in ({"unit": "h"}, {"confidence": 0.0}, {"confidence": 1.5}):
        with pytest.raises(ValueError):
            stats.latency_stats(df, **wrong)


@pytest.mark.parametrize("block", [1024, 3])
def test_distortion(spark, block, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK_ROWS", block)
    rng = np.random.default_rng(8)
    x, z = rng.normal(size=(10, 4)), rng.normal(size=(10, 6))
    rows = spark.createDataFrame([(0, i, x[i].tolist(), z[i].tolist()) for i in range(10)], "batch_id int, vec_id int, x array<double>, z array<double>")
    gx, gz = x @ x.T, z @ z.T
    want = np.linalg.norm(gx / np.diag(gx)[:, None] - gz / np.diag(gz)[:, None]) / 10
    assert stats.relative_distance_distortion(rows, 2.0).first().distortion == pytest.approx(2.0 * want)
    empty = rows.withColumn("z", F.transform("z", lambda v: v * 0.0))
    assert stats.relative_distance_distortion(empty).first().distortion is None


def test_distortion_of_batches_of_several_sizes(spark, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(9)
    sizes, want, data = {0: 1, 1: 8, 2: 50, 3: 200}, {}, []
    for batch, n in sizes.items():
        x = rng.normal(size=(n, 5)) + 1.0
        z = x if batch == 3 else rng.normal(size=(n, 3)) + 1.0
        gx, gz = x @ x.T, z @ z.T
        want[batch] = np.linalg.norm(gx / np.diag(gx)[:, None] - gz / np.diag(gz)[:, None]) / n
        data += [(batch, i, x[i].tolist(), z[i].tolist()) for i in range(n)]
    # Batches of equal widths share a table.
    for chosen in ([0, 1, 2], [3]):
        rows = spark.createDataFrame([r for r in data if r[0] in chosen], "batch_id int, vec_id int, x array<double>, z array<double>")
        got = {r.batch_id: r.distortion for r in stats.relative_distance_distortion(rows.repartition(7)).collect()}
        assert got == {b: pytest.approx(want[b], abs=1e-7) for b in chosen}


def test_penalties_count_empty_rows(spark):
    postings = spark.createDataFrame([("a", 0, 2.0), ("b", 0, -1.0), ("a", 1, 1e-4)], POSTING)
    rows = docs(spark, 0, 1, 2, 3)
    assert stats.l1_penalty(postings, 2.0).first().l1 == pytest.approx(2 * 3.0001)
    assert stats.flops_penalty(postings, rows).first().flops == pytest.approx((2.0001 / 4) ** 2 + 0.25**2)
    row = stats.sparsity_stats(postings, rows).first()
    assert (row.nonzero_per_row, row.above_threshold_per_row) == (0.75, 0.5)
    x = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, 0.0])], "vec_id int, vec array<double>")
    y = spark.createDataFrame([(0, [1.0, 4.0]), (1, [0.0, 2.0])], "vec_id int, vec array<double>")
    assert stats.reconstruction_mse(x, y, 3.0).first().mse == pytest.approx(6.0)


def test_staleness(spark):
    fired = spark.createDataFrame([(0, 0, 1.0), (1, 2, 1.0), (1, 0, 1.0), (2, 1, 0.0)], "latent int, batch bigint, weight double")
    latents = spark.createDataFrame([(i,) for i in range(4)], "latent int")
    assert {r.latent: r.staleness for r in stats.latent_staleness(fired, latents, 3).collect()} == {0: 3, 1: 1, 2: 3, 3: 3}


def test_size_checks_and_lineage(spark):
    assert arrow_if_small(spark.range(10), 8, 80).num_rows == 10
    assert arrow_if_small(spark.range(11), 8, 80) is None
    kept = cut_lineage(spark.range(5).withColumn("x", F.col("id") * 2))
    assert kept.count() == 5 and shared_dir(spark)


def test_statistics_grow_by_a_stream(spark, tmp_path):
    texts = ["a b a", "b c", None, "", "a", "c c c d", "e", "a e"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    source, root = str(tmp_path / "in"), str(tmp_path / "statistics")
    for number in range(3):
        rows.where(F.col("doc_id") % 3 == number).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def run(state):
        statistics_stream(stream, root, str(tmp_path / state)).trigger(availableNow=True).start().awaitTermination()

    def found():
        return sorted(map(tuple, term_statistics.stored_statistics(spark, root).collect()))

    run("state")
    whole = lexical.doc_tokens(rows.fillna("", "text"))
    want = sorted(map(tuple, lexical.collection_statistics(whole).collect()))
    assert len(list((tmp_path / "statistics" / "totals").glob("writer=*/epoch=*"))) == 3
    assert found() == want
    assert next(iter(want))[5] == 8
    with pytest.raises(Exception, match="hold a document"):
        run("state of another stream")
    assert found() == want
    # A batch that died before its totals does not count and is written anew.
    epoch = next(iter((tmp_path / "statistics" / "totals").glob("writer=*/epoch=1")))
    (epoch / "_SUCCESS").unlink()
    assert len(found()) < len(want)
    writer = epoch.parent.name.split("=")[1]
    ids = [r.doc_id for r in spark.read.parquet(f"{root}/lengths/writer={writer}/epoch=1").collect()]
    term_statistics.append_statistics(whole.where(F.col("doc_id").isin(ids)), root, writer, 1)
    assert found() == want


def test_statistics_refuse_repeated_documents(spark, tmp_path):
    root = str(tmp_path / "statistics")
    with pytest.raises(FileNotFoundError):
        term_statistics.stored_totals(spark, root)
    twice = spark.createDataFrame([(1, ["a"]), (1, ["b"])], "doc_id bigint, tokens array<string>")
    with pytest.raises(ValueError, match="twice"):
        term_statistics.append_statistics(twice, root)
    term_statistics.append_statistics(twice.limit(0), root)
    assert term_statistics.stored_statistics(spark, root).count() == 0
