"""Postings, thresholds, weights and sparse search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidra.functions.numeric import report
from lexidra.functions.text import term_name as name_of
from lexidra.operators import postings as P
from lexidra.operators import search as S
from lexidra.operators.bounded import bounded_index, bounded_search
from lexidra.operators.encoders import hash_static_vectors
from lexidra.operators.lexical import each_once, query_term_counts, together
from lexidra.operators.pooling import calibrate_threshold, mean_pooling
from lexidra.operators.pooling import sparta_pooling as sparta
from lexidra.operators.pooling import splade_pooling as splade
from lexidra.plans.dictionary import text_token_vectors
from lexidra.functions.text import tokenize
from registry import tables
from registry.sql import QTERMS, TF, TOKENS, VECTORS, score_sum, tokens_of, topk
from registry.sql import report as sql_report

DEPTH = 1000
SHORT = 10
MATCH_RATIO = 0.5
QUANTILE = 0.1
ABS_LIMIT = 0.05


def to_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.to_sparse(tables.vectors(spark, sf_dir), "vec_id", "vec")


def term_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.vectors(spark, sf_dir).select("label").distinct()
    return rows.select("label", name_of("label").alias("term"))


def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components at or above the threshold calibrated on the first two passages."""
    items = tables.queries(spark, sf_dir)
    pooled = mean_pooling(text_token_vectors(items, "query_id"), 16)
    threshold = calibrate_threshold(pooled, F.col("doc_id") == 0, F.col("doc_id") == 1)
    kept = P.score_threshold(P.to_sparse(tables.vectors(spark, sf_dir), "vec_id", "vec"), threshold)
    return kept.select("vec_id", "term", "weight")


def zero_by_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.zero_by_quantile(tables.vectors(spark, sf_dir), QUANTILE)
    return tables.components(rows, "vec_id").where(F.col("value") != 0)


def zero_by_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.components(P.zero_by_abs(tables.vectors(spark, sf_dir), ABS_LIMIT), "vec_id")


def _heavy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query weights with a few above the limit: squared counts times the term length."""
    terms = query_term_counts(tables.queries(spark, sf_dir))
    return terms.withColumn("weight", F.col("weight") * F.col("weight") * F.length("term"))


def prepare_query_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.prepare_query_weights(_heavy_terms(spark, sf_dir))
    return rows.withColumn("weight", report("weight"))


def validate_query_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.check_query_weights(_heavy_terms(spark, sf_dir))


def sparse_dot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sparse_dot_search(_heavy_terms(spark, sf_dir), tables.tf_postings(spark, sf_dir), DEPTH)


def min_should_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sparse_dot_search(
        _heavy_terms(spark, sf_dir), tables.tf_postings(spark, sf_dir), DEPTH, min_match_ratio=MATCH_RATIO
    )


def unweighted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unweighted_search(_heavy_terms(spark, sf_dir), tables.tf_postings(spark, sf_dir), DEPTH)


def weighted_sum_all_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.weighted_sum_all_docs(
        query_term_counts(tables.queries(spark, sf_dir)),
        tables.tf_postings(spark, sf_dir),
        tables.corpus(spark, sf_dir),
        DEPTH,
    )


def all_docs_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents in the clamped form."""
    terms = query_term_counts(tables.queries(spark, sf_dir))
    docs, postings = tables.corpus(spark, sf_dir), tables.tf_postings(spark, sf_dir)
    return S.weighted_sum_all_docs(terms, postings, docs, SHORT, clamp_negative=True)


def sparse_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sparse_dot_search(_heavy_terms(spark, sf_dir), tables.tf_postings(spark, sf_dir), SHORT)


def bounded_sparse_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by block bounds."""
    terms = P.prepare_query_weights(_heavy_terms(spark, sf_dir)).select("query_id", "term", "weight")
    return bounded_search(terms, bounded_index(tables.tf_postings(spark, sf_dir), asked=terms), SHORT)


def splade_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled queries against pooled documents, the ten best of each."""
    items = tables.queries(spark, sf_dir).select(F.col("query_id").alias("doc_id"), "text")
    terms = splade(_token_logits(tokenize(items))).withColumnRenamed("doc_id", "query_id")
    run = S.sparse_dot_search(terms, splade(_logits(spark, sf_dir), whole=True, asked=terms), SHORT, whole=True)
    return run.withColumn("score", report("score"))


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_logits(tokenize(together(tables.corpus(spark, sf_dir))))


def _token_logits(tokens: DataFrame) -> DataFrame:
    """Stand-in logits: a function of token length and place; some short tokens score at or below 0."""
    length = F.length("token").cast("double")
    return tokens.select(
        "doc_id", "pos", F.col("token").alias("term"), (length / F.lit(4.0) - F.lit(0.5) + F.col("pos") % 7).alias("logit")
    )


def splade_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splade(_logits(spark, sf_dir), whole=True).withColumn("weight", report("weight"))


def _sparta_postings(spark: SparkSession, sf_dir: str, whole: bool) -> DataFrame:
    words = tokenize(tables.queries(spark, sf_dir), "query_id").select(F.col("token").alias("term")).distinct()
    return sparta(text_token_vectors(tables.corpus(spark, sf_dir)), hash_static_vectors(words), whole=whole)


def sparta_whole_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages against every word of the documents, so that the cut at 2000 terms binds."""
    words = tokenize(tables.corpus(spark, sf_dir)).select(F.col("token").alias("term")).distinct()
    passages = text_token_vectors(tables.queries(spark, sf_dir), "query_id")
    return sparta(passages, hash_static_vectors(words)).withColumn("weight", report("weight"))


def _document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the documents over every word of theirs, those of a document in one partition and in a row."""
    words = tokenize(tables.corpus(spark, sf_dir)).select(F.col("token").alias("term")).distinct()
    return sparta(text_token_vectors(together(tables.corpus(spark, sf_dir))), hash_static_vectors(words), whole=True)


def sparta_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents against every word of theirs."""
    return _document_terms(spark, sf_dir).withColumn("weight", report("weight"))


def token_bag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages' bags of tokens against documents that have terms of the whole vocabulary."""
    tokens = tokenize(tables.queries(spark, sf_dir), "query_id").select("query_id", "token")
    run = S.token_bag_search(tokens, _document_terms(spark, sf_dir), DEPTH, whole=True)
    return run.withColumn("score", report("score"))


def sparta_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = each_once(tables.corpus(spark, sf_dir))
    return _sparta_postings(spark, sf_dir, whole).withColumn("weight", report("weight"))


def token_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tokenize(tables.queries(spark, sf_dir), "query_id").select("query_id", "token")
    whole = each_once(tables.corpus(spark, sf_dir))
    run = S.token_bag_search(tokens, _sparta_postings(spark, sf_dir, whole), DEPTH, whole)
    return run.withColumn("score", report("score"))


QUERIES = {
    "to_sparse": to_sparse,
    "term_name": term_name,
    "score_threshold": score_threshold,
    "zero_by_quantile": zero_by_quantile,
    "zero_by_abs": zero_by_abs,
    "prepare_query_weights": prepare_query_weights,
    "validate_query_weight": validate_query_weight,
    "sparse_dot_search": sparse_dot_search,
    "min_should_match": min_should_match,
    "unweighted_search": unweighted_search,
    "weighted_sum_all_docs": weighted_sum_all_docs,
    "all_docs_top10": all_docs_top10,
    "sparse_top10": sparse_top10,
    "bounded_sparse_top10": bounded_sparse_top10,
    "splade_pooling": splade_pooling,
    "splade_search": splade_search,
    "sparta_pooling": sparta_pooling,
    "sparta_whole_vocabulary": sparta_whole_vocabulary,
    "sparta_documents": sparta_documents,
    "token_bag_documents": token_bag_documents,
    "token_bag_search": token_bag_search,
}


def hash_bytes(token: str) -> str:
    """The digest bytes of a token, moved to -128 .. 127, as columns b0 .. b15."""
    parts = []
    for i in range(16):
        parts.append(f"CAST('0x' || substr(md5({token}), {2 * i + 1}, 2) AS BIGINT) - 128 AS b{i}")
    return ", ".join(parts)


def token_vectors(texts: str, prefix: str) -> str:
    """CTEs ending in ``{prefix}v(doc_id, dl, pos, token, v0 .. v15)`` for ``texts(doc_id, text)``."""
    mix = ", ".join(
        f"""(4 * h.b{i} + 2 * (coalesce(a.b{i}, 0) + coalesce(b.b{i}, 0)) + coalesce(c.b{i}, 0)
            + coalesce(e.b{i}, 0))::DOUBLE / 1024.0::DOUBLE AS v{i}"""
        for i in range(16)
    )
    return f"""{prefix}l AS MATERIALIZED (SELECT doc_id, {tokens_of('text')} AS toks FROM {texts}),
      {prefix}t AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM {prefix}l),
      {prefix}w AS (SELECT *, lag(token, 1) OVER p AS l1, lead(token, 1) OVER p AS r1, lag(token, 2) OVER p AS l2,
          lead(token, 2) OVER p AS r2 FROM {prefix}t WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
      {prefix}h AS MATERIALIZED (SELECT token AS tk, {hash_bytes('token')} FROM (SELECT DISTINCT token FROM {prefix}t)),
      {prefix}v AS MATERIALIZED (SELECT w.doc_id, w.dl, w.pos, w.token, {mix} FROM {prefix}w w JOIN {prefix}h h ON h.tk = w.token
          LEFT JOIN {prefix}h a ON a.tk = w.l1 LEFT JOIN {prefix}h b ON b.tk = w.r1
          LEFT JOIN {prefix}h c ON c.tk = w.l2 LEFT JOIN {prefix}h e ON e.tk = w.r2)"""


DOC_VECTORS = token_vectors("documents", "d")
ITEM_VECTORS = token_vectors("(SELECT item_id AS doc_id, text FROM benchmark)", "q")

_HEAVY = f"""{QTERMS}, hq AS MATERIALIZED (SELECT query_id, term, weight * weight * length(term) AS weight FROM qt),
    mx AS (SELECT query_id, max(weight) AS mw, count(*) AS n_terms FROM hq GROUP BY query_id),
    pq AS (SELECT query_id, term, CASE WHEN mw > 64 THEN weight * (64.0::DOUBLE / mw) ELSE weight END AS weight, n_terms
        FROM hq JOIN mx USING (query_id))"""


def _scored(weight: str, having: str = "") -> str:
    return f"""(SELECT query_id, doc_id, {score_sum(f'{weight} * tf.tf')} AS score FROM pq JOIN tf USING (term)
        GROUP BY query_id, doc_id {having})"""


_ENOUGH = f"HAVING count(*) >= greatest(1, ceil({MATCH_RATIO} * max(n_terms)))"
_ALL_DOCS = f"""(SELECT q.query_id, d.doc_id, coalesce(s.score, 0.0) AS score FROM (SELECT DISTINCT query_id FROM qt) q
    CROSS JOIN (SELECT doc_id FROM documents) d LEFT JOIN (SELECT query_id, doc_id, {score_sum('qt.weight * tf.tf')} AS score
    FROM qt JOIN tf USING (term) GROUP BY ALL) s ON s.query_id = q.query_id AND s.doc_id = d.doc_id)"""
_SPARTA = f"""{DOC_VECTORS},
    vocab AS MATERIALIZED (SELECT token AS term, {hash_bytes('token')} FROM
        (SELECT DISTINCT unnest({tokens_of('text')}) AS token FROM benchmark)),
    best AS (SELECT doc_id, term, max({' + '.join(f'v{i} * (b{i}::DOUBLE / 128.0::DOUBLE)' for i in range(16))}) AS top
        FROM dv, vocab GROUP BY doc_id, term),
    sp AS MATERIALIZED (SELECT doc_id, term, ln(1.0::DOUBLE + score) AS weight FROM
        (SELECT doc_id, term, floor(top * 1e9 + 0.5) / 1e9 AS score FROM best) WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) <= 2000)"""

_SPLADE = """SELECT doc_id, term, ln(1.0::DOUBLE + max(logit)) AS weight FROM
    (SELECT doc_id, token AS term, length(token)::DOUBLE / 4.0::DOUBLE - 0.5::DOUBLE + pos % 7 AS logit FROM {})
    WHERE logit > 0 GROUP BY doc_id, term"""

ORACLE = {
    "to_sparse": f"WITH {VECTORS} SELECT vec_id, dim, 'term_' || dim AS term, x AS weight FROM x WHERE x <> 0",
    "term_name": "SELECT DISTINCT CAST(label AS BIGINT) AS label, 'term_' || label AS term FROM embeddings",
    "score_threshold": f"""WITH {VECTORS}, {ITEM_VECTORS},
        m AS (SELECT doc_id, {', '.join(f'sum(v{i}) / count(*) AS m{i}' for i in range(16))} FROM qv WHERE doc_id IN (0, 1) GROUP BY doc_id)
        SELECT vec_id, 'term_' || dim AS term, x AS weight FROM x WHERE x <> 0 AND x >=
          (SELECT 0.8::DOUBLE * ({' + '.join(f'a.m{i} * b.m{i}' for i in range(16))}) FROM m a, m b WHERE a.doc_id = 0 AND b.doc_id = 1)""",
    "zero_by_quantile": f"""WITH {VECTORS}, q AS (SELECT vec_id, quantile_cont(x, {QUANTILE}) AS lo, quantile_cont(x, {1 - QUANTILE}) AS hi
        FROM x GROUP BY vec_id) SELECT vec_id, dim, x AS value FROM x JOIN q USING (vec_id) WHERE (x <= lo OR x >= hi) AND x <> 0""",
    "zero_by_abs": f"WITH {VECTORS} SELECT vec_id, dim, CASE WHEN abs(x) < {ABS_LIMIT} THEN 0.0 ELSE x END AS value FROM x",
    "prepare_query_weights": f"WITH {_HEAVY} SELECT query_id, term, {sql_report('weight')} AS weight, n_terms FROM pq",
    "validate_query_weight": f"WITH {_HEAVY} SELECT query_id, term, weight FROM hq WHERE isfinite(weight)",
    "sparse_dot_search": f"WITH {TF}, {_HEAVY} SELECT query_id, doc_id, score, rank FROM {topk(_scored('pq.weight'), DEPTH)}",
    "min_should_match": f"WITH {TF}, {_HEAVY} SELECT query_id, doc_id, score, rank FROM {topk(_scored('pq.weight', _ENOUGH), DEPTH)}",
    "unweighted_search": f"WITH {TF}, {_HEAVY} SELECT query_id, doc_id, score, rank FROM {topk(_scored('1.0::DOUBLE'), DEPTH)}",
    "weighted_sum_all_docs": f"WITH {TF}, {QTERMS} SELECT query_id, doc_id, score, rank FROM {topk(_ALL_DOCS, DEPTH)}",
    "all_docs_top10": f"WITH {TF}, {QTERMS} SELECT query_id, doc_id, score, rank FROM {topk(_ALL_DOCS, SHORT)}",
    "sparse_top10": f"WITH {TF}, {_HEAVY} SELECT query_id, doc_id, score, rank FROM {topk(_scored('pq.weight'), SHORT)}",
    "bounded_sparse_top10": f"WITH {TF}, {_HEAVY} SELECT query_id, doc_id, score, rank FROM {topk(_scored('pq.weight'), SHORT)}",
    "splade_search": f"""WITH {TOKENS}, qd AS MATERIALIZED (SELECT item_id AS doc_id, {tokens_of('text')} AS toks FROM benchmark),
        qtok AS (SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM qd),
        dp AS MATERIALIZED ({_SPLADE.format('tok')}), qp AS MATERIALIZED ({_SPLADE.format('qtok')}),
        sc AS (SELECT qp.doc_id AS query_id, dp.doc_id, {score_sum('qp.weight * dp.weight')} AS score FROM qp JOIN dp USING (term) GROUP BY ALL)
        SELECT query_id, doc_id, {sql_report('score')} AS score, rank FROM {topk('sc', SHORT)}""",
    "splade_pooling": f"""WITH {TOKENS} SELECT doc_id, term, {sql_report('ln(1.0::DOUBLE + max(logit))')} AS weight FROM
        (SELECT doc_id, token AS term, length(token)::DOUBLE / 4.0::DOUBLE - 0.5::DOUBLE + pos % 7 AS logit FROM tok)
        WHERE logit > 0 GROUP BY doc_id, term""",
    "sparta_pooling": f"WITH {_SPARTA} SELECT doc_id, term, {sql_report('weight')} AS weight FROM sp",
    "sparta_whole_vocabulary": f"""WITH {ITEM_VECTORS},
        words AS (SELECT DISTINCT unnest({tokens_of('text')}) AS token FROM documents),
        vocab AS MATERIALIZED (SELECT token AS term, {hash_bytes('token')} FROM words),
        best AS (SELECT doc_id, term, max({' + '.join(f'v{i} * (b{i}::DOUBLE / 128.0::DOUBLE)' for i in range(16))}) AS top
          FROM qv, vocab GROUP BY doc_id, term)
        SELECT doc_id, term, {sql_report('ln(1.0::DOUBLE + score)')} AS weight FROM
          (SELECT doc_id, term, floor(top * 1e9 + 0.5) / 1e9 AS score FROM best) WHERE score > 0
          QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) <= 2000""",
    "token_bag_search": f"""WITH {_SPARTA}, {QTERMS},
        sc AS (SELECT query_id, doc_id, {score_sum('qt.weight * sp.weight')} AS score FROM qt JOIN sp USING (term) GROUP BY ALL)
        SELECT query_id, doc_id, {sql_report('score')} AS score, rank FROM {topk('sc', DEPTH)}""",
}
