"""Ranking quality of the BM25 run against the passage judgments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidra.operators import evaluation
from lexidra.plans.lexical import evaluate_bm25
from lexidra.operators.lexical import bm25_search
from registry import tables
from registry.lexical import BM25_SQL
from registry.sql import score_sum, snap

DEPTH = 1000


def evaluate_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate_bm25(tables.corpus(spark, sf_dir), tables.queries(spark, sf_dir), tables.gold(spark, sf_dir), DEPTH)


def _single(measure: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        run = bm25_search(tables.queries(spark, sf_dir), tables.corpus(spark, sf_dir), DEPTH)
        return measure(tables.gold(spark, sf_dir), run)

    return query


def evaluate_run_descending_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same run with whole scores, so that many hits are tied."""
    run = bm25_search(tables.queries(spark, sf_dir), tables.corpus(spark, sf_dir), DEPTH)
    return evaluation.evaluate_run(tables.gold(spark, sf_dir), run.withColumn("score", F.floor("score").cast("double")), ties="descending")


QUERIES = {
    "evaluate_run": evaluate_run,
    "evaluate_run_descending_ties": evaluate_run_descending_ties,
    "ndcg_at_k": _single(evaluation.ndcg_at_k),
    "map_at_k": _single(evaluation.map_at_k),
    "recall_at_k": _single(evaluation.recall_at_k),
    "precision_at_k": _single(evaluation.precision_at_k),
    "mrr_at_k": _single(evaluation.mrr_at_k),
}


def metrics_sql(run: str, qrels: str, ties: str = "ASC") -> str:
    """All measures of ``run(query_id, doc_id, score)`` against ``qrels(query_id, doc_id, rel)``."""

    def mean(value: str, only: str = "retrieved") -> str:
        total = score_sum(f"CASE WHEN {only} THEN {value} END")
        return snap(f"coalesce({total} / nullif(count(*) FILTER ({only}), 0), 0.0)", "1e5")

    return f"""(WITH run0 AS ({run}), qr AS ({qrels}),
      hits AS (SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id,
          row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id {ties}) AS rank
          FROM run0 WHERE CAST(query_id AS VARCHAR) <> CAST(doc_id AS VARCHAR)) WHERE rank <= 1000),
      rel AS (SELECT h.query_id, h.rank, q.rel, count(*) OVER (PARTITION BY h.query_id ORDER BY h.rank) AS seen
          FROM hits h JOIN qr q ON h.query_id = q.query_id AND h.doc_id = q.doc_id WHERE q.rel > 0),
      ks AS (SELECT unnest([1, 3, 5, 10, 100, 1000])::BIGINT AS k),
      found AS (SELECT query_id, k, {score_sum('rel / log2(rank + 1.0)')} AS dcg,
          {score_sum('seen::DOUBLE / rank')} AS prec_sum, count(*) AS hits, min(rank) AS first
          FROM rel JOIN ks ON rank <= k GROUP BY query_id, k),
      best AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS rank
          FROM qr WHERE rel > 0),
      ideal AS (SELECT query_id, k, {score_sum('rel / log2(rank + 1.0)')} AS idcg FROM best JOIN ks ON rank <= k GROUP BY query_id, k),
      tot AS (SELECT query_id, count(*) FILTER (rel > 0) AS n_rel FROM qr GROUP BY query_id),
      pq AS (SELECT t.query_id, ks.k, t.query_id IN (SELECT query_id FROM hits) AS retrieved,
          coalesce(f.dcg / nullif(i.idcg, 0), 0.0) AS ndcg, coalesce(f.prec_sum / nullif(n_rel, 0), 0.0) AS ap,
          coalesce(f.hits::DOUBLE / nullif(n_rel, 0), 0.0) AS recall, coalesce(f.hits, 0)::DOUBLE / ks.k AS prec,
          coalesce(1.0::DOUBLE / f.first, 0.0) AS rr
          FROM tot t CROSS JOIN ks LEFT JOIN found f ON f.query_id = t.query_id AND f.k = ks.k
          LEFT JOIN ideal i ON i.query_id = t.query_id AND i.k = ks.k)
      SELECT 'ndcg' AS metric, k, {mean('ndcg')} AS value FROM pq GROUP BY k
      UNION ALL SELECT 'map', k, {mean('ap')} FROM pq GROUP BY k
      UNION ALL SELECT 'recall', k, {mean('recall')} FROM pq GROUP BY k
      UNION ALL SELECT 'precision', k, {mean('prec')} FROM pq GROUP BY k
      UNION ALL SELECT 'mrr', k, {mean('rr', 'true')} FROM pq GROUP BY k)"""


_GOLD = """SELECT b.item_id AS query_id, d.doc_id, 1 AS rel FROM documents d JOIN benchmark b ON contains(d.text, b.text)"""
METRICS_SQL = f"SELECT metric, k, value FROM {metrics_sql(BM25_SQL, _GOLD)}"

ORACLE = {
    "evaluate_run": METRICS_SQL,
    "evaluate_run_descending_ties": f"""SELECT metric, k, value FROM
        {metrics_sql(f'SELECT query_id, doc_id, floor(score) AS score FROM ({BM25_SQL})', _GOLD, 'DESC')}""",
    **{
        key: f"{METRICS_SQL} WHERE metric = '{name}'"
        for key, name in (
            ("ndcg_at_k", "ndcg"),
            ("map_at_k", "map"),
            ("recall_at_k", "recall"),
            ("precision_at_k", "precision"),
            ("mrr_at_k", "mrr"),
        )
    },
}
