"""Ranking quality: NDCG, MAP, recall, precision and MRR as long ``(metric, k, value)`` rows.

NDCG, MAP, recall and precision average over the queries found in both the run and the
judgments; MRR averages over all judged queries.  Hits on the query's own id are dropped.
Ties are broken by ``doc_id``: ``ties`` is ``ascending``, or ``descending`` as in the usual
command-line evaluation tool, which takes ids as strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexidra.functions.numeric import score_sum, snap
from lexidra.operators.postings import drop_self_hits
from lexidra.operators.ranking import rank_topk
from lexidra.session import cut_lineage

K_VALUES = (1, 3, 5, 10, 100, 1000)
METRICS = ("ndcg", "map", "recall", "precision", "mrr")
METRIC_DIGITS = 1e5
TIES = ("ascending", "descending")


def judged_hits(run: DataFrame, qrels: DataFrame, depth: int, ties: str = "ascending") -> DataFrame:
    """The top ``depth`` hits per query with their grade: ``(query_id, doc_id, rank, rel)``.

    The run is cut before the judgment join, so every later window sees at most
    ``depth`` rows per query.
    """
    if ties not in TIES:
        raise ValueError(f"unknown order of ties {ties!r}, expected one of {TIES}")
    top = rank_topk(drop_self_hits(run).select("query_id", "doc_id", "score"), depth, tie_descending=ties == "descending")
    grades = qrels.select("query_id", "doc_id", F.col("rel").cast("bigint").alias("rel"))
    return (
        top.join(grades, ["query_id", "doc_id"], "left")
        .withColumn("rel", F.coalesce("rel", F.lit(0).cast("bigint")))
        .select("query_id", "doc_id", "rank", "rel")
    )


def _gain(rel: Column, rank: Column) -> Column:
    return rel.cast("double") / F.log2(rank.cast("double") + F.lit(1.0))


def _per_k(rows: DataFrame, k_values: tuple[int, ...]) -> DataFrame:
    """Repeat each ranked row for every cut-off that contains it."""
    cutoffs = F.array(*[F.lit(k).cast("bigint") for k in k_values])
    return rows.withColumn("k", F.explode(F.filter(cutoffs, lambda k: k >= F.col("rank"))))


def _query_grid(queries: DataFrame, k_values: tuple[int, ...]) -> DataFrame:
    return queries.withColumn("k", F.explode(F.array(*[F.lit(k).cast("bigint") for k in k_values])))


def per_query_measures(
    run: DataFrame, qrels: DataFrame, k_values: tuple[int, ...] = K_VALUES, ties: str = "ascending"
) -> DataFrame:
    """One row per judged query and cut-off: ``(query_id, k, retrieved, ndcg, ap, recall, precision, rr)``.

    The judged hits, at most ``max(k_values)`` per query, are stored once: a run is often the
    end of a long search, and several measures read it.
    """
    depth = max(k_values)
    hits = cut_lineage(judged_hits(run, qrels, depth, ties))
    retrieved = hits.select("query_id").distinct().withColumn("retrieved", F.lit(True))

    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    relevant = (
        hits.where(F.col("rel") > 0)
        .withColumn("seen", F.count("*").over(running))
        .withColumn("dcg", _gain(F.col("rel"), F.col("rank")))
        .withColumn("prec", F.col("seen").cast("double") / F.col("rank"))
    )
    found = _per_k(relevant, k_values).groupBy("query_id", "k").agg(
        score_sum("dcg").alias("dcg"),
        score_sum("prec").alias("prec_sum"),
        F.count("*").alias("hits"),
        F.min("rank").alias("first"),
    )

    graded = qrels.where(F.col("rel") > 0).select("query_id", "doc_id", F.col("rel").cast("bigint").alias("rel"))
    ideal_rows = rank_topk(graded, depth, score="rel").withColumn("idcg", _gain(F.col("rel"), F.col("rank")))
    ideal = _per_k(ideal_rows, k_values).groupBy("query_id", "k").agg(score_sum("idcg").alias("idcg"))
    totals = qrels.groupBy("query_id").agg(F.count_if(F.col("rel") > 0).alias("n_rel"))

    grid = _query_grid(totals, k_values)
    joined = (
        grid.join(found, ["query_id", "k"], "left")
        .join(ideal, ["query_id", "k"], "left")
        .join(retrieved, "query_id", "left")
        .fillna({"dcg": 0.0, "prec_sum": 0.0, "hits": 0, "idcg": 0.0, "retrieved": False})
    )
    n_rel = F.col("n_rel").cast("double")
    zero = F.lit(0.0)
    return joined.select(
        "query_id",
        "k",
        "retrieved",
        F.coalesce(F.try_divide("dcg", "idcg"), zero).alias("ndcg"),
        F.coalesce(F.try_divide(F.col("prec_sum"), n_rel), zero).alias("ap"),
        F.coalesce(F.try_divide(F.col("hits").cast("double"), n_rel), zero).alias("recall"),
        (F.col("hits").cast("double") / F.col("k")).alias("precision"),
        F.coalesce(F.lit(1.0) / F.col("first"), zero).alias("rr"),
    )


_SOURCE = {"ndcg": "ndcg", "map": "ap", "recall": "recall", "precision": "precision", "mrr": "rr"}


def evaluate_run(
    qrels: DataFrame,
    run: DataFrame,
    k_values: tuple[int, ...] = K_VALUES,
    metric: str | None = None,
    ties: str = "ascending",
) -> DataFrame:
    """All measures, or the single one named by ``metric``: ``(metric, k, value)`` rounded to five digits."""
    names = METRICS if metric is None else (metric,)
    unknown = [name for name in names if name not in _SOURCE]
    if unknown:
        raise ValueError(f"unknown metric {unknown[0]!r}, expected one of {METRICS}")
    measures = per_query_measures(run, qrels, k_values, ties)
    means = []
    for name in names:
        value = F.col(_SOURCE[name])
        counted = F.lit(True) if name == "mrr" else F.col("retrieved")
        mean = F.try_divide(score_sum(F.when(counted, value)), F.count_if(counted))
        means.append(snap(F.coalesce(mean, F.lit(0.0)), METRIC_DIGITS).alias(name))
    wide = measures.groupBy("k").agg(*means)
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    return wide.select(F.explode(pairs).alias("m"), "k").select("m.metric", "k", "m.value")


def ndcg_at_k(qrels: DataFrame, run: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    return evaluate_run(qrels, run, k_values, "ndcg")


def map_at_k(qrels: DataFrame, run: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    return evaluate_run(qrels, run, k_values, "map")


def recall_at_k(qrels: DataFrame, run: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    return evaluate_run(qrels, run, k_values, "recall")


def precision_at_k(qrels: DataFrame, run: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    return evaluate_run(qrels, run, k_values, "precision")


def mrr_at_k(qrels: DataFrame, run: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    return evaluate_run(qrels, run, k_values, "mrr")
