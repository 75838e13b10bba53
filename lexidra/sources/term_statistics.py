"""Term statistics that grow with their collection: every batch of documents adds its own part.

Layout, one folder for each batch in each part::

    <root>/{lengths,frequencies,terms,totals}/writer=<w>/epoch=<e>

``lengths(doc_id, dl)`` and ``frequencies(doc_id, dl, term, tf)`` hold the documents, ``terms(term, df)`` and
``totals(n_docs, total_dl)`` what the batch adds to the statistics.  Document frequencies, numbers of documents and
total lengths are sums over batches, so weights of the whole collection come from sums of small tables,
and no stored document is read again when a batch arrives.  ``totals`` is written last: a batch exists once that is complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidra.operators.lexical import BM25_B, BM25_K1, bm25_rank, document_frequencies, query_term_counts, term_frequencies
from lexidra.operators.ranking import DEFAULT_TOP_K
from lexidra.session import child_names, path_exists

LENGTHS, FREQUENCIES, TERMS, TOTALS = "lengths", "frequencies", "terms", "totals"


def _batch(root: str, part: str, writer: str, epoch: int) -> str:
    return f"{root}/{part}/writer={writer}/epoch={epoch}"


def _complete(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """The complete batches, in order."""
    writers = [name.split("=", 1)[1] for name in child_names(spark, f"{root}/{TOTALS}") if name.startswith("writer=")]
    epochs = [(w, int(name.split("=")[1])) for w in writers for name in child_names(spark, f"{root}/{TOTALS}/writer={w}") if name.startswith("epoch=")]
    return sorted(b for b in epochs if path_exists(spark, f"{_batch(root, TOTALS, *b)}/_SUCCESS"))


def _read(spark: SparkSession, root: str, part: str) -> DataFrame:
    batches = _complete(spark, root)
    if not batches:
        raise FileNotFoundError(f"no statistics at {root}")
    return spark.read.parquet(*[_batch(root, part, *b) for b in batches])


def append_statistics(tokenized: DataFrame, root: str, writer: str = "appends", epoch: int = 0) -> None:
    """Add the documents of ``tokenized(doc_id, tokens, dl)``.

    ``(writer, epoch)`` names the batch: a complete one is not written again, one that died half
    way is.  A null list of tokens counts as an empty document.  A document listed twice, or held
    already, makes the append fail before anything of it counts.
    """
    spark = tokenized.sparkSession
    done = _complete(spark, root)
    if (writer, epoch) in done:
        return
    paths = {part: _batch(root, part, writer, epoch) for part in (LENGTHS, FREQUENCIES, TERMS, TOTALS)}
    rows = tokenized.select("doc_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    rows = rows.withColumn("dl", F.size("tokens").cast("bigint"))
    rows.select("doc_id", "dl").write.mode("overwrite").parquet(paths[LENGTHS])
    lengths = spark.read.parquet(paths[LENGTHS])
    if not lengths.groupBy("doc_id").count().where("count > 1").isEmpty():
        raise ValueError("a document is listed twice in this batch")
    if done and not lengths.join(_read(spark, root, LENGTHS), "doc_id", "left_semi").isEmpty():
        raise ValueError("the statistics hold a document of this batch already")
    # Sorted by term, so that a search skips row groups without its terms; a frequent term spans many files.
    frequencies = term_frequencies(rows).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    frequencies.write.mode("overwrite").parquet(paths[FREQUENCIES])
    document_frequencies(spark.read.parquet(paths[FREQUENCIES])).write.mode("overwrite").parquet(paths[TERMS])
    totals = lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint").alias("total_dl"))
    totals.write.mode("overwrite").parquet(paths[TOTALS])


def stored_totals(spark: SparkSession, root: str) -> Column:
    """Scalar struct ``(n_docs, avg_dl)`` of all batches."""
    n_docs = F.sum("n_docs")
    avg_dl = F.try_divide(F.sum("total_dl").cast("double"), n_docs)
    return _read(spark, root, TOTALS).agg(F.struct(n_docs.alias("n_docs"), avg_dl.alias("avg_dl")).alias("totals")).scalar()


def stored_document_frequencies(spark: SparkSession, root: str) -> DataFrame:
    """``(term, df)`` of all batches."""
    return _read(spark, root, TERMS).groupBy("term").agg(F.sum("df").alias("df"))


def stored_statistics(spark: SparkSession, root: str) -> DataFrame:
    """What ``collection_statistics`` gives for the documents of all batches, without their texts."""
    rows = _read(spark, root, FREQUENCIES).join(stored_document_frequencies(spark, root), "term")
    rows = rows.withColumn("_totals", stored_totals(spark, root))
    return rows.select("doc_id", "term", "tf", "df", "dl", "_totals.n_docs", "_totals.avg_dl")


def stored_bm25_search(
    spark: SparkSession, queries: DataFrame, root: str, k: int = DEFAULT_TOP_K, k1: float = BM25_K1, b: float = BM25_B
) -> DataFrame:
    """``bm25_search`` over the documents of all batches, with weights of the present statistics."""
    totals = stored_totals(spark, root)
    terms, frequencies = query_term_counts(queries), _read(spark, root, FREQUENCIES)
    return bm25_rank(terms, frequencies, stored_document_frequencies(spark, root), totals, k, k1, b)
