"""The given tables in the roles of corpus, queries, judgments and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidra.functions.numeric import report
from lexidra.functions.text import tokens_of
from lexidra.functions.vectors import as_double
from lexidra.operators.lexical import doc_tokens, term_frequencies
from lexidra.session import SHIP_BYTES, cut_lineage, fill_cores

VEC_DIM = 64
ANCHOR = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("title"), "text")
    return fill_cores(rows, "doc_id")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _shingles(tokens: Column) -> Column:
    words = [lambda i, j=j: F.get(tokens, i + j) for j in range(ANCHOR)]
    return F.transform(tokens, lambda _, i: F.xxhash64(*[w(i) for w in words]))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments ``(query_id, doc_id, rel)``: 1 where the document contains the passage.

    A document that contains a passage also contains its inner tokens in a row, so candidates
    come from an equality join on a hash of the first inner tokens; the texts are compared only
    for those.  Passages without enough inner tokens are compared directly, in lists of about
    the shipping bound.
    """
    docs, items = corpus(spark, sf_dir).select("doc_id", "text"), queries(spark, sf_dir)
    inner = F.slice(F.col("toks"), 2, F.greatest(F.size("toks") - F.lit(2), F.lit(0)))
    tokenized = items.withColumn("toks", tokens_of("text")).withColumn("inner", inner)
    long = tokenized.where(F.size("inner") >= ANCHOR)
    anchors = long.select("query_id", F.xxhash64(*[F.col("inner")[j] for j in range(ANCHOR)]).alias("shingle"))
    placed = docs.withColumn("toks", tokens_of("text")).select(
        "doc_id", F.explode(F.array_distinct(_shingles(F.col("toks")))).alias("shingle")
    )
    pairs = placed.join(anchors, "shingle").select("query_id", "doc_id").distinct()
    passages = items.withColumnRenamed("text", "passage")
    found = (
        pairs.join(docs, "doc_id")
        .join(passages, "query_id")
        .where(F.contains(F.col("text"), F.col("passage")))
        .select("query_id", "doc_id")
    )
    short = tokenized.where(F.size("inner") < ANCHOR).select("query_id", F.col("text").alias("passage"))
    size = short.agg(F.coalesce(F.sum(F.length("passage") * F.lit(4)), F.lit(0)).alias("n")).first()["n"]
    slices = -(-int(size) // SHIP_BYTES)
    for number in range(slices):
        part = short.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == number)
        direct = docs.join(F.broadcast(part), F.contains(F.col("text"), F.col("passage")))
        found = found.unionByName(direct.select("query_id", "doc_id"))
    return cut_lineage(found.withColumn("rel", F.lit(1).cast("bigint")))


def tf_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term counts of the documents as postings ``(term, doc_id, weight)``."""
    frequencies = term_frequencies(doc_tokens(corpus(spark, sf_dir)))
    return frequencies.select("term", "doc_id", F.col("tf").cast("double").alias("weight"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, label, vec)``."""
    rows = fill_cores(table(spark, sf_dir, "embeddings"), "vec_id")
    return rows.select("vec_id", F.col("label").cast("bigint").alias("label"), as_double("embedding").alias("vec"))


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the component means of its vectors, ``(query_id, vec)``."""
    means = components(vectors(spark, sf_dir), "label").groupBy("label", "dim").agg(report(F.avg("value")).alias("m"))
    packed = F.array_sort(F.collect_list(F.struct("dim", "m")))
    return means.groupBy(F.col("label").alias("query_id")).agg(packed.alias("p")).select("query_id", F.col("p.m").alias("vec"))


def components(df: DataFrame, id_col: str, vec_col: str = "vec", value: str = "value") -> DataFrame:
    """``(id, dim, value)`` of every component."""
    return df.select(id_col, F.posexplode(vec_col).alias("dim", value)).withColumn("dim", F.col("dim").cast("bigint"))
