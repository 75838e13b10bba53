"""Lexical search and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexidra.operators.evaluation import K_VALUES, evaluate_run
from lexidra.operators.lexical import bm25_search
from lexidra.operators.ranking import DEFAULT_TOP_K


def evaluate_bm25(
    docs: DataFrame, queries: DataFrame, qrels: DataFrame, k: int = DEFAULT_TOP_K, k_values: tuple[int, ...] = K_VALUES
) -> DataFrame:
    """Metrics of a BM25 run: ``(metric, k, value)``."""
    return evaluate_run(qrels, bm25_search(queries, docs, k), k_values)
