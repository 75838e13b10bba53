"""SQL fragments shared by the counterparts."""

from __future__ import annotations

TOKEN_LIST = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def tokens_of(text: str) -> str:
    return TOKEN_LIST.format(text)


def snap(expr: str, scale: str = "1e9") -> str:
    return f"(floor(({expr}) * {scale} + 0.5) / {scale})"


def report(expr: str) -> str:
    return snap(expr, "1e6")


def score_sum(expr: str) -> str:
    return f"(CAST(sum(CAST(floor(({expr}) * 1e9 + 0.5) AS BIGINT)) AS DOUBLE) / 1e9)"


DOCS = f"d AS MATERIALIZED (SELECT doc_id, {tokens_of('text')} AS toks FROM documents)"
TOKENS = (
    DOCS
    + """, tok AS MATERIALIZED (SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos,
        len(toks) AS dl FROM d)"""
)
TF = TOKENS + ", tf AS MATERIALIZED (SELECT doc_id, dl, token AS term, count(*) AS tf FROM tok GROUP BY ALL)"
QTERMS = f"""qt AS MATERIALIZED (SELECT query_id, term, CAST(count(*) AS DOUBLE) AS weight FROM (
    SELECT item_id AS query_id, unnest({tokens_of('text')}) AS term FROM benchmark) GROUP BY ALL)"""


def topk(source: str, k: int, columns: str = "query_id, doc_id, score", group: str = "query_id", tie: str = "doc_id") -> str:
    """Ranked cut of ``source`` by score."""
    return f"""(SELECT {columns}, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, {tie}) AS rank
        FROM {source} QUALIFY rank <= {k})"""


VECTORS = """x AS MATERIALIZED (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
    generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"""
LABEL_QUERIES = (
    VECTORS + f", lq AS MATERIALIZED (SELECT label AS query_id, dim, {report('avg(x)')} AS x FROM x GROUP BY ALL)"
)
