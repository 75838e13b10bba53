"""One query for each operator of this package, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidra.llm import chat, language, merkle, periodic, secret_scan
from lexidra.llm.cover_search import top_products
from lexidra.llm.exact_dedup import exact_groups
from lexidra.llm.line_dedup import dedup_lines
from lexidra.llm.mixing import mix_report
from lexidra.llm.packing import pack
from lexidra.llm.resample import weigh
from lexidra.llm.simhash import simhash_components
from lexidra.llm.tables import table
from lexidra.llm.token_counts import token_counts

BYTE_BPE = "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "text")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an even id are the snapshot, all others the incoming batch."""
    docs = table(spark, sf_dir, "documents")
    return exact_groups(docs, F.coalesce(F.col("doc_id") % 2 != 0, F.lit(True)))


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op8_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("row.doc_id", "n_grams", "log_weight", "key", "kept")


def op9_cover_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(periodic.collapse_runs(periodic.planted(table(spark, sf_dir, "documents"))))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose CRC-32 leaves 1 are held out; a null id is not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return language.identify(table(spark, sf_dir, "documents"), ~held_out, {"doc_id": F.col("doc_id"), "held_out": held_out})


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_harmonic_packing": op6_harmonic_packing,
    "op7_simhash": op7_simhash,
    "op8_quality_resampling": op8_quality_resampling,
    "op9_cover_search": op9_cover_search,
    "op10_token_counts": op10_token_counts,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_language": op12_language,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_INTEGERS = "[floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding]"

NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

ORACLE: dict[str, str] = {
    "op1_secret_scan": secret_scan.sql(),
    "op2_chat_formatting": chat.SQL,
    "op4_mixing": r"""
        WITH d AS MATERIALIZED (
            SELECT doc_id, source, md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS key,
                len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, 3 * source_size AS most, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
        r AS (SELECT *, row_number() OVER o AS k, (sum(source_size) OVER ()) - coalesce(sum(most) OVER
                (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy
            FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
        f AS (SELECT min(k) AS k0, arg_min(rest, k) AS rest0, arg_min(heavy, k) AS heavy0
            FROM r WHERE rest * weight <= most * heavy),
        t AS MATERIALIZED (SELECT source, source_size, CASE WHEN k < k0 THEN CAST(most AS DOUBLE)
                ELSE CAST(rest0 * weight AS DOUBLE) / CAST(heavy0 AS DOUBLE) END AS target FROM r, f),
        b AS (SELECT greatest(1, least(64, CAST(sum(source_size) AS BIGINT) // 10000)) AS block,
            CAST(sum(source_size) AS BIGINT) AS total FROM t),
        k AS MATERIALIZED (SELECT d.*, source_size, target, CAST(('0x' || substr(key, 1, 8)) AS BIGINT)
            % greatest(1, CAST(ceil(source_size / 262144) AS BIGINT)) AS shard
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        c AS MATERIALIZED (SELECT source, shard, CAST(sum(size) AS BIGINT) AS words,
            any_value(target) * CAST(sum(size) AS BIGINT) / any_value(source_size) AS votes
            FROM k GROUP BY source, shard HAVING sum(size) > 0),
        q AS (SELECT source, shard, votes / (i + 0.5) AS quotient, total // block AS seats
            FROM (SELECT c.*, b.*, unnest(range(CAST(ceil(words * 3 / block) AS BIGINT))) AS i FROM c, b)),
        g AS (SELECT source, shard, count(*) AS quota FROM (SELECT * FROM q QUALIFY
            row_number() OVER (ORDER BY quotient DESC, source NULLS LAST, shard) <= seats) GROUP BY ALL),
        p AS (SELECT c.source, c.shard, words, least(coalesce(quota, 0) * block, words * 3) AS take,
                CAST(('0x' || substr(md5('7:' || coalesce(c.source, 'null') || ':' || c.shard), 1, 8)) AS BIGINT)
                    % CAST(ceil(words / block) AS BIGINT) * block AS "begin"
            FROM c CROSS JOIN b LEFT JOIN g ON c.source IS NOT DISTINCT FROM g.source AND c.shard = g.shard),
        l AS (SELECT k.*, words, take // words AS rounds, take % words AS run, "begin", CAST(sum(size) OVER (PARTITION BY k.source, k.shard
                ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS spot
            FROM k LEFT JOIN p ON k.source IS NOT DISTINCT FROM p.source AND k.shard = p.shard)
        SELECT doc_id, size, source_size, target, CAST(coalesce(rounds * size
            + greatest(0, least("begin" + run, words, spot + size) - greatest("begin", spot))
            + greatest(0, least("begin" + run - words, spot + size) - spot), 0) AS BIGINT) AS taken
        FROM l""",
    "op5_exact_dedup": f"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256({NORMAL}) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
            row_number() OVER w = 1 AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)""",
    "op9_cover_search": f"""
        WITH v AS MATERIALIZED (SELECT vec_id, {_INTEGERS} AS v FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.v, v.v) AS BIGINT) AS score
            FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
    "op11_periodic_runs": periodic.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
