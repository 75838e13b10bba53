"""Corpus, query and judgment files; truncation and duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidra.functions.text import assemble_text
from lexidra.operators.ranking import first_rows

CORPUS_SCHEMA = "_id string, title string, text string"
QUERY_SCHEMA = "_id string, text string"
QREL_SCHEMA = "`query-id` string, `corpus-id` string, score int"
# Row numbers inside a task take the low 33 bits of Spark's increasing ids.
ROWS_PER_TASK = 2**33
SPLITS = ("train", "dev", "test")


def read_corpus(spark: SparkSession, path: str, with_line_order: bool = False) -> DataFrame:
    """``corpus.jsonl`` with ``_id, title, text`` as ``(doc_id, title, text)``.

    ``with_line_order`` adds ``line_order``, a unique number that grows with the line of a single
    file, so that "the first n documents" has a meaning for text ids: the start of the split the
    line was read from, then the row number inside the task.
    """
    rows = spark.read.schema(CORPUS_SCHEMA).json(path)
    columns = [F.col("_id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.col("text")]
    if with_line_order:
        row_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit(ROWS_PER_TASK - 1))
        start = F.col("_metadata.file_block_start").cast("decimal(20,0)")
        columns.append((start * F.lit(ROWS_PER_TASK) + row_in_task).alias("line_order"))
    return rows.select(*columns)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``queries.jsonl`` with ``_id, text`` as ``(query_id, text)``."""
    return spark.read.schema(QUERY_SCHEMA).json(path).select(F.col("_id").alias("query_id"), "text")


def read_qrels(spark: SparkSession, folder: str, split: str = "test") -> DataFrame:
    """``{folder}/{split}.tsv`` with a header line as ``(query_id, doc_id, rel)``."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}, expected one of {SPLITS}")
    rows = spark.read.schema(QREL_SCHEMA).csv(f"{folder}/{split}.tsv", sep="\t", header=True)
    return rows.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id"), F.col("score").alias("rel"))


def with_full_text(corpus: DataFrame) -> DataFrame:
    """Add ``contents``: title and text as one trimmed string."""
    title = F.col("title") if "title" in corpus.columns else None
    return corpus.withColumn("contents", assemble_text(title, F.col("text")))


def truncate_corpus(corpus: DataFrame, length: int | None, order_col: str = "doc_id") -> DataFrame:
    """The first ``length`` documents in the order of ``order_col`` (None: all)."""
    if length is None:
        return corpus
    if length < 1:
        raise ValueError("length must be at least 1")
    return first_rows(corpus, order_col, length)


def truncate_with_judgments(
    corpus: DataFrame, queries: DataFrame, qrels: DataFrame, length: int | None, order_col: str = "doc_id"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First ``length`` documents, the judgments on them (any grade) and the queries that keep one."""
    if length is None:
        return corpus, queries, qrels
    kept = truncate_corpus(corpus, length, order_col)
    kept_qrels = qrels.join(kept.select("doc_id"), "doc_id", "left_semi")
    kept_queries = queries.join(kept_qrels.select("query_id"), "query_id", "left_semi")
    return kept, kept_queries, kept_qrels


def dedup_corpus(corpus: DataFrame, text_col: str = "text", order_col: str = "doc_id") -> DataFrame:
    """Drop exact copies of a text; the row with the lowest ``order_col`` stays.

    Texts are grouped by digest with a map-side minimum, so neither a third of the corpus
    being one text nor the length of the texts loads a single task; whole rows move only
    in the semi join, whose key is unique.
    """
    digest = F.sha2(F.col(text_col), 256).alias("_digest")
    keepers = corpus.groupBy(digest).agg(F.min(order_col).alias(order_col))
    return corpus.join(keepers.select(order_col), order_col, "left_semi")


def export_corpus_jsonl(corpus: DataFrame, path: str) -> None:
    """Write ``{id, title, contents}`` lines."""
    title = F.coalesce("title", F.lit("")) if "title" in corpus.columns else F.lit("")
    corpus.select(
        F.col("doc_id").alias("id"), title.alias("title"), F.coalesce("text", F.lit("")).alias("contents")
    ).write.mode("overwrite").json(path)
