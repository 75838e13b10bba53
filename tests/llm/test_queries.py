"""Every query of the package: equal to its SQL, or valid without one."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import pytest
from compare import differences

from lexidra.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert differences(got, con.execute(ORACLE[name]).df()) is None


@pytest.mark.parametrize("name", ["op3_line_dedup", "op7_simhash", "op8_quality_resampling"])
def test_one_row_per_document(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = sorted(r.doc_id for r in QUERIES[name](spark, sf_dir).select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_token_counts_follow_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) for r in docs}
    got = QUERIES["op10_token_counts"](spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 512) and r.n_bytes for r in got)


def test_pipeline_equals_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, sf_dir), "test-stage")
        assert out.dtypes == docs.dtypes, name
        assert out.where("n_chars <> length(text)").count() == 0
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    whole = corpus_pipeline.run(spark, sf_dir).toPandas()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, last[columns].values)) == sorted(map(tuple, whole[columns].values))
    assert last.groupby("sequence_id").length.sum().max() <= 2048
