"""Per-token vector dictionary: train, index with MaxSim weights, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexidra.operators.clustering import CLUSTERS_PER_TOKEN, train_vector_dictionary
from lexidra.operators.encoders import HASH_DIM, hash_token_vectors
from lexidra.operators.lexical import doc_tokens
from lexidra.operators.neighbors import nearest_centroids
from lexidra.operators.pooling import maxsim_document_vector
from lexidra.operators.postings import drop_terms, score_threshold
from lexidra.operators.quantized import nearest_centroids_approx
from lexidra.operators.ranking import DEFAULT_TOP_K
from lexidra.operators.search import unweighted_search
from lexidra.session import cut_lineage

INDEX_NEIGHBORS = 8
SEARCH_NEIGHBORS = 3


def text_token_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Contextual vectors of the built-in encoder for whole texts."""
    return hash_token_vectors(doc_tokens(docs, id_col, text_col))


def build_dictionary(
    token_vecs: DataFrame,
    dim: int = HASH_DIM,
    k: int = CLUSTERS_PER_TOKEN,
    iterations: int | None = None,
    stop: list | None = None,
    seeding: str = "distance",
) -> DataFrame:
    """``(term, token, cluster, vec)``; special tokens in ``stop`` get no entries."""
    return train_vector_dictionary(drop_terms(token_vecs, stop or []), dim, k, iterations, seeding)


def _neighbors(vecs: DataFrame, dictionary: DataFrame, n: int, approximate: bool) -> DataFrame:
    search = nearest_centroids_approx if approximate else nearest_centroids
    return search(vecs, dictionary.select("term", "vec"), n)


def index_documents(
    token_vecs: DataFrame,
    dictionary: DataFrame,
    n: int = INDEX_NEIGHBORS,
    threshold: float | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Postings ``(doc_id, term, weight)``: neighbours of all positions, weighted by MaxSim."""
    keyed = token_vecs.select(F.struct("doc_id", "dl", "pos").alias("query_id"), "vec")
    near = _neighbors(keyed, dictionary, n, approximate)
    candidates = near.select("query_id.doc_id", "query_id.dl", "term").distinct()
    weights = maxsim_document_vector(token_vecs, candidates, dictionary.select("term", "vec"))
    return score_threshold(weights, threshold)


def dictionary_query(
    query_vecs: DataFrame, dictionary: DataFrame, n: int = SEARCH_NEIGHBORS, approximate: bool = False
) -> DataFrame:
    """Query terms ``(query_id, term)``: the distinct ``n`` nearest entries of all query tokens."""
    keyed = query_vecs.select(F.struct(F.col("doc_id").alias("id"), "pos").alias("query_id"), "vec")
    near = _neighbors(keyed, dictionary, n, approximate)
    return near.select(F.col("query_id.id").alias("query_id"), "term").distinct()


def dictionary_search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_TOP_K,
    iterations: int | None = None,
    threshold: float | None = None,
    approximate: bool = False,
) -> DataFrame:
    """The whole method over ``docs(doc_id, text)`` and ``queries(query_id, text)``."""
    token_vecs = text_token_vectors(docs)
    dictionary = cut_lineage(build_dictionary(token_vecs, iterations=iterations))
    postings = index_documents(token_vecs, dictionary, threshold=threshold, approximate=approximate)
    query_vecs = text_token_vectors(queries, "query_id")
    return unweighted_search(dictionary_query(query_vecs, dictionary, approximate=approximate), postings, k)
