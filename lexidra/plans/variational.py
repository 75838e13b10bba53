"""Variational sparse vectors: cluster label, mean and variance nets, sampling, zeroing, search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexidra.operators.encoders import mlp_score, mlp_variance, sampled_vector
from lexidra.operators.neighbors import assign_cluster
from lexidra.operators.postings import to_sparse, zero_small
from lexidra.operators.ranking import DEFAULT_TOP_K
from lexidra.operators.search import sparse_dot_search

Layers = list[tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class VariationalModel:
    """``centroids(cluster, vec)`` and the layers ``(weights(out, inp, w), bias(out, b))`` of both nets.

    The nets take a vector followed by the one-hot label of its nearest centroid.
    """

    centroids: DataFrame
    mean: Layers
    log_variance: Layers
    activation: str = "lrelu"
    slope: float = 0.1


def encode_variational(
    vectors: DataFrame,
    model: VariationalModel,
    threshold: float | None = None,
    zeroing: str = "quantile",
    seed: int = 0,
    id_col: str = "vec_id",
) -> DataFrame:
    """Dense vectors ``(id, vec)`` to postings ``(id, dim, term, weight)`` of sampled latents.

    The noise is a function of seed, id and dimension, so the same row always has the same
    latents.  Zeroed components have no posting.
    """
    labelled = assign_cluster(vectors, model.centroids, id_col).select(id_col, F.col("vec_with_label").alias("mu"))
    both = labelled.withColumn("v", F.col("mu"))
    both = mlp_score(both, model.mean, model.activation, model.slope, id_col, "mu")
    both = mlp_variance(both, model.log_variance, model.activation, model.slope, id_col, "v")
    latents = both.select(id_col, sampled_vector(F.col(id_col), F.col("mu"), F.col("v"), seed).alias("vec"))
    return to_sparse(zero_small(latents, threshold, zeroing), id_col, "vec")


def variational_search(
    docs: DataFrame,
    queries: DataFrame,
    model: VariationalModel,
    threshold: float | None = None,
    zeroing: str = "quantile",
    seed: int = 0,
    k: int = DEFAULT_TOP_K,
) -> DataFrame:
    """Sparse search of ``queries(query_id, vec)`` over ``docs(doc_id, vec)``."""
    postings = encode_variational(docs, model, threshold, zeroing, seed, "doc_id")
    terms = encode_variational(queries, model, threshold, zeroing, seed, "query_id").select("query_id", "term", "weight")
    return sparse_dot_search(terms, postings, k, max_weight=None)
