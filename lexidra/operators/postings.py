"""Sparse vectors as postings rows ``(term, doc_id, weight)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexidra.functions.text import term_name
from lexidra.functions.vectors import as_double, let

MAX_QUERY_WEIGHT = 64.0


def to_sparse(df: DataFrame, id_col: str = "doc_id", vec_col: str = "embedding") -> DataFrame:
    """Nonzero components as ``(id, dim, term, weight)``; accepts ``[V]`` and ``[1, V]`` arrays."""
    vec = as_double(_one_row_vector(df, vec_col))
    return (
        df.select(id_col, F.posexplode(vec).alias("dim", "weight"))
        .where(F.col("weight") != 0.0)
        .select(id_col, F.col("dim").cast("bigint").alias("dim"), term_name("dim").alias("term"), "weight")
    )


def _one_row_vector(df: DataFrame, vec_col: str) -> Column:
    kind = df.schema[vec_col].dataType
    numeric = (T.NumericType,)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, numeric):
        return F.col(vec_col)
    if (
        isinstance(kind, T.ArrayType)
        and isinstance(kind.elementType, T.ArrayType)
        and isinstance(kind.elementType.elementType, numeric)
    ):
        single = F.size(vec_col) == 1
        return F.when(single, F.col(vec_col)[0]).otherwise(
            F.raise_error(F.lit("expected a vector of shape [V] or [1, V]"))
        )
    raise ValueError(f"expected a vector of shape [V] or [1, V], got {kind.simpleString()}")


def score_threshold(postings: DataFrame, threshold: float | Column | None, weight: str = "weight") -> DataFrame:
    """Keep postings whose weight reaches ``threshold`` (None keeps all)."""
    if threshold is None:
        return postings
    bound = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return postings.where(F.col(weight) >= bound)


def drop_terms(rows: DataFrame, stop: list, column: str = "token") -> DataFrame:
    """Remove special or stop tokens."""
    return rows.where(~F.col(column).isin(list(stop)))


def drop_self_hits(run: DataFrame) -> DataFrame:
    """Remove results whose document is the query itself (ids compared as text)."""
    return run.where(F.col("query_id").cast("string") != F.col("doc_id").cast("string"))


def prepare_query_weights(
    query_terms: DataFrame, weighted: bool = True, max_weight: float = MAX_QUERY_WEIGHT
) -> DataFrame:
    """Check and scale the weights of ``(query_id, term, weight)``; adds ``n_terms``.

    Without weights every term counts 1.  If the largest weight of a query exceeds
    ``max_weight`` all its weights shrink by the same factor.  NaN and infinite weights
    raise.
    """
    rows = query_terms if weighted else query_terms.select("query_id", "term", F.lit(1.0).alias("weight"))
    rows = check_query_weights(rows.withColumn("weight", F.col("weight").cast("double")))
    per_query = rows.groupBy("query_id").agg(F.max("weight").alias("_max"), F.count("*").alias("n_terms"))
    scaled = F.when(
        F.col("_max") > max_weight, F.col("weight") * (F.lit(max_weight) / F.col("_max"))
    ).otherwise(F.col("weight"))
    return rows.join(per_query, "query_id").select("query_id", "term", scaled.alias("weight"), "n_terms")


def check_query_weights(rows: DataFrame, weight: str = "weight") -> DataFrame:
    """Raise at run time on a weight that is NaN or infinite."""
    bad = F.isnan(weight) | (F.abs(F.col(weight)) == F.lit(float("inf")))
    message = F.lit("query term weight must be finite and not NaN")
    return rows.withColumn(weight, F.when(bad, F.raise_error(message)).otherwise(F.col(weight)))


def duplicate_postings(postings: DataFrame) -> DataFrame:
    """``(doc_id, term)`` pairs posted more than once; empty for a valid index."""
    return postings.groupBy("doc_id", "term").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def index_stats(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: documents, distinct terms, average posting-list length.

    Documents are counted in ``docs``: a document whose terms were all filtered out
    still belongs to the index.
    """
    per_term = postings.groupBy("term").agg(F.count("*").alias("n"))
    lists = per_term.agg(F.count("*").alias("n_terms"), F.sum("n").alias("n_postings"))
    n_docs = docs.agg(F.count_distinct("doc_id").alias("n")).scalar()
    return lists.select(
        n_docs.cast("bigint").alias("n_docs"),
        F.col("n_terms").cast("bigint").alias("n_terms"),
        F.try_divide(F.col("n_postings").cast("double"), F.col("n_terms")).alias("avg_list_length"),
    )


def zero_by_quantile(df: DataFrame, threshold: float, vec_col: str = "vec", out: str = "vec") -> DataFrame:
    """Zero the middle of every vector: keep ``z <= q(t)`` or ``z >= q(1 - t)``.

    Quantiles interpolate linearly and are taken from the sorted array inside the row.
    """

    def quantile(ordered: Column, q: float) -> Column:
        place = F.lit(q) * (F.size(ordered) - F.lit(1))
        below, above = F.get(ordered, F.floor(place).cast("int")), F.get(ordered, F.ceil(place).cast("int"))
        return below + (above - below) * (place - F.floor(place))

    def keep(vec: Column, low: Column, high: Column) -> Column:
        return F.transform(vec, lambda z: F.when((z <= low) | (z >= high), z).otherwise(F.lit(0.0)))

    vec = as_double(vec_col)
    bounds = let(
        F.sort_array(vec),
        lambda ordered: F.struct(quantile(ordered, threshold).alias("lo"), quantile(ordered, 1.0 - threshold).alias("hi")),
    )
    return df.withColumn(out, let(bounds, lambda b: keep(vec, b["lo"], b["hi"])))


def zero_by_abs(df: DataFrame, threshold: float, vec_col: str = "vec", out: str = "vec") -> DataFrame:
    """Zero every component with ``abs(z) < threshold``."""
    keep = F.transform(as_double(vec_col), lambda z: F.when(F.abs(z) < threshold, F.lit(0.0)).otherwise(z))
    return df.withColumn(out, keep)


def zero_small(df: DataFrame, threshold: float | None, kind: str = "quantile", vec_col: str = "vec") -> DataFrame:
    """Apply the zeroing rule ``kind`` (``quantile`` or ``threshold``)."""
    if threshold is None:
        return df
    if kind == "quantile":
        return zero_by_quantile(df, threshold, vec_col, vec_col)
    if kind == "threshold":
        return zero_by_abs(df, threshold, vec_col, vec_col)
    raise ValueError(f"zeroing type {kind!r} is not supported")


def topk_activation(df: DataFrame, k: int, id_col: str = "doc_id", vec_col: str = "z") -> DataFrame:
    """Postings ``(id, dim, term, weight)`` of the ``k`` largest values per row after ReLU.

    Largest by value, not by magnitude; ties go to the smaller dimension.  The vector is
    ordered inside its row, so the operator needs no shuffle.
    """
    pairs = F.transform(as_double(vec_col), lambda z, i: F.struct((-z).alias("neg"), i.alias("dim")))
    best = F.slice(F.array_sort(pairs), 1, k)
    return (
        df.select(id_col, F.explode(best).alias("best"))
        .select(
            id_col,
            F.col("best.dim").cast("bigint").alias("dim"),
            term_name(F.col("best.dim")).alias("term"),
            F.greatest(-F.col("best.neg"), F.lit(0.0)).alias("weight"),
        )
        .where(F.col("weight") > 0.0)
    )
