"""Sparse latents: layer norm, linear encoder, top-k activation, search, decoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexidra.operators.encoders import layer_norm, linear_encode
from lexidra.operators.postings import topk_activation
from lexidra.operators.ranking import DEFAULT_TOP_K
from lexidra.operators.search import sparse_dot_search

LATENTS = 3000
ACTIVE = 600


@dataclass(frozen=True)
class LinearModel:
    """``weights(latent, dim, w)``, ``pre_bias(dim, b)``, ``latent_bias(latent, b)``."""

    weights: DataFrame
    pre_bias: DataFrame
    latent_bias: DataFrame
    normalize: bool = False


def encode_sparse(vectors: DataFrame, model: LinearModel, k: int = ACTIVE, id_col: str = "vec_id", vec_col: str = "vec") -> DataFrame:
    """Dense vectors to postings ``(id, dim, term, weight)``; no shuffle from scan to postings."""
    rows = vectors.select(id_col, F.col(vec_col).cast("array<double>").alias("z"))
    if model.normalize:
        rows = layer_norm(rows, "z").select(id_col, "z")
    encoded = linear_encode(rows, model.weights, model.pre_bias, model.latent_bias, id_col=id_col, vec_col="z")
    return topk_activation(encoded, k, id_col, "z")


def latent_search(
    docs: DataFrame, queries: DataFrame, model: LinearModel, active: int = ACTIVE, k: int = DEFAULT_TOP_K
) -> DataFrame:
    """Sparse search of ``queries(query_id, vec)`` over ``docs(doc_id, vec)``."""
    postings = encode_sparse(docs, model, active, "doc_id")
    terms = encode_sparse(queries, model, active, "query_id").select("query_id", "term", "weight")
    return sparse_dot_search(terms, postings, k)
