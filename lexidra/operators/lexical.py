"""Term statistics and BM25 weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexidra.functions.numeric import score_sum
from lexidra.functions.text import tokens_of
from lexidra.functions.vectors import let
from lexidra.operators.ranking import DEFAULT_TOP_K, rank_topk
from lexidra.operators.search import best_in_documents, by_document, shipped_terms
from lexidra.session import SHIP_BYTES

BM25_K1 = 1.2
BM25_B = 0.75


def doc_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_length: int | None = None) -> DataFrame:
    """``(doc_id, tokens array, dl)``: the tokenized document, still one row."""
    tokens = docs.select(F.col(id_col).alias("doc_id"), tokens_of(text_col, max_length).alias("tokens"))
    return tokens.withColumn("dl", F.size("tokens").cast("bigint"))


def each_once(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether no two rows share an id; what a row is expanded into is then a whole document."""
    return docs.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col("n") > 1).isEmpty()


def together(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of an id one after the other in one partition: as they are where no two rows share one, otherwise shuffled by it."""
    return docs if each_once(docs, id_col) else docs.repartition(id_col).sortWithinPartitions(id_col)


def token_to_docs(tokenized: DataFrame, stop: list | None = None) -> DataFrame:
    """The set of documents of every token as long rows ``(token, doc_id)``, without the tokens in ``stop``.

    The set stays long: a frequent token may occur in a third of all documents, and an
    array of them would have to be built in one task.  Repetitions are removed inside the
    document's row, so nothing is shuffled.
    """
    rows = tokenized.select(F.explode(F.array_distinct("tokens")).alias("token"), "doc_id")
    return rows if not stop else rows.where(~F.col("token").isin(list(stop)))


def _runs(tokens: Column) -> Column:
    """Distinct tokens with their counts, read off the sorted token array."""

    def starts(ordered: Column) -> Column:
        begins = lambda t, i: F.when((i == 0) | (F.get(ordered, i - 1) != t), i)
        return F.filter(F.transform(ordered, begins), lambda i: i.isNotNull())

    def entries(ordered: Column, begin: Column) -> Column:
        def entry(i: Column, j: Column) -> Column:
            end = F.coalesce(F.get(begin, j + 1), F.size(ordered))
            return F.struct(F.get(ordered, i).alias("term"), (end - i).cast("bigint").alias("tf"))

        return F.transform(begin, entry)

    return let(F.sort_array(tokens), lambda ordered: let(starts(ordered), lambda begin: entries(ordered, begin)))


def term_frequencies(tokenized: DataFrame) -> DataFrame:
    """``(doc_id, dl, term, tf)``.

    A document is one row, so its terms are counted there: no shuffle, and a frequent term
    is no different from a rare one.
    """
    return tokenized.select("doc_id", "dl", F.inline(_runs(F.col("tokens"))))


def document_frequencies(frequencies: DataFrame) -> DataFrame:
    """``(term, df)``."""
    return frequencies.groupBy("term").agg(F.count("*").alias("df"))


def corpus_totals(tokenized: DataFrame) -> Column:
    """Scalar struct ``(n_docs, avg_dl)``; one pass that shuffles no tokens."""
    n_docs = F.count("*")
    avg_dl = F.try_divide(F.sum("dl").cast("double"), n_docs)
    return tokenized.agg(F.struct(n_docs.alias("n_docs"), avg_dl.alias("avg_dl")).alias("totals")).scalar()


def collection_statistics(tokenized: DataFrame) -> DataFrame:
    """Everything BM25 needs, per posting: ``(doc_id, term, tf, df, dl, n_docs, avg_dl)``."""
    frequencies = term_frequencies(tokenized)
    return (
        frequencies.join(document_frequencies(frequencies), "term")
        .withColumn("_totals", corpus_totals(tokenized))
        .select("doc_id", "term", "tf", "df", "dl", "_totals.n_docs", "_totals.avg_dl")
    )


def _bm25_weight(k1: float, b: float) -> Column:
    """Contribution of one query occurrence of a term, from ``tf, df, dl`` and the corpus totals."""
    n_docs, avg_dl = F.col("_totals.n_docs").cast("double"), F.col("_totals.avg_dl")
    df, tf = F.col("df").cast("double"), F.col("tf").cast("double")
    idf = F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))
    saturation = tf / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl").cast("double") / avg_dl))
    return idf * saturation


def bm25_postings(tokenized: DataFrame, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """Postings ``(term, doc_id, weight)`` to be stored: a dot product with token counts is the BM25 score.

    Lengths and weights are exact, where a search library would store them in reduced precision.
    """
    frequencies = term_frequencies(tokenized)
    counted = frequencies.join(document_frequencies(frequencies), "term").withColumn("_totals", corpus_totals(tokenized))
    return counted.select("term", "doc_id", _bm25_weight(k1, b).alias("weight"))


def query_term_counts(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """Queries as bags of tokens: ``(query_id, term, weight)`` with the number of occurrences as weight."""
    return (
        queries.select("query_id", F.explode(tokens_of(text_col)).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").cast("double").alias("weight"))
    )


def bm25_search(
    queries: DataFrame,
    docs: DataFrame,
    k: int = DEFAULT_TOP_K,
    k1: float = BM25_K1,
    b: float = BM25_B,
    text_col: str = "text",
    ship_bytes: int = SHIP_BYTES,
) -> DataFrame:
    """Rank documents for every query: any query token may match, repeated tokens count again.

    Document frequencies join the query side, so the corpus takes part in one join only.  A
    query batch of bounded size is shipped to the scan, where a document is scored whole in its
    own task and only the best hits of a task are shuffled; a larger batch is joined.  The corpus
    is tokenized once per use of the counts, which moves no data, rather than shuffled to be
    used twice.
    """
    tokenized = doc_tokens(docs, text_col=text_col)
    frequencies = term_frequencies(tokenized)
    counts, totals = document_frequencies(frequencies), corpus_totals(tokenized)
    # Rows that share an id are one document, and have to meet.
    return bm25_rank(query_term_counts(queries), frequencies, counts, totals, k, k1, b, each_once(docs), ship_bytes)


def bm25_rank(
    terms: DataFrame,
    frequencies: DataFrame,
    counts: DataFrame,
    totals: Column,
    k: int,
    k1: float = BM25_K1,
    b: float = BM25_B,
    whole: bool = False,
    ship_bytes: int = SHIP_BYTES,
) -> DataFrame:
    """Ranked hits of ``terms(query_id, term, weight)`` from ``(doc_id, dl, term, tf)``, ``(term, df)`` and ``(n_docs, avg_dl)``.

    ``whole`` says that the frequencies of a document are neighbours in one partition.
    """
    shipped = shipped_terms(terms, k, ship_bytes)
    if shipped is not None:
        known = F.broadcast(counts.join(shipped.asked.select("term"), "term", "left_semi"))
        weighted = frequencies.join(known, "term").withColumn("_totals", totals).withColumn("weight", _bm25_weight(k1, b))
        weighted = weighted.select("term", "doc_id", "weight")
        placed = weighted.join(shipped.asked, "term") if whole else by_document(weighted, shipped)
        return rank_topk(best_in_documents(placed, shipped, k), k)
    asked = counts.join(terms.select("term").distinct(), "term", "left_semi")
    matched = frequencies.join(terms.join(asked, "term"), "term").withColumn("_totals", totals)
    scored = matched.groupBy("query_id", "doc_id").agg(score_sum(F.col("weight") * _bm25_weight(k1, b)).alias("score"))
    return rank_topk(scored, k)
