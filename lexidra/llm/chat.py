"""Chat formatting: cumulative snapshots collapse to the longest conversation, which is rendered.

The turns of a conversation are numbered in order; the hash of a prefix is the combination of
its turns' hashes, each made with its number, so it rolls from turn to turn and adds up over
blocks of turns.  A conversation whose whole hash is the prefix of a longer one is removed by an
anti-join, and of equal conversations the one with the smallest id stays.  Only DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexidra.llm.tables import named, stored

BLOCK_TURNS = 256
# How a turn is rendered.
BEFORE_ROLE, AFTER_ROLE, AFTER_TEXT = "<|im_start|>", "\n", "<|im_end|>\n"


def _numbered(turns: DataFrame) -> DataFrame:
    """``(conv_id, block, number, role, text)``: distinct turns numbered from 1 within their conversation.

    Numbers are counted block by block, so a conversation with very many turns is many groups.
    """
    rows = named(turns, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    block = F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit((1 << 62))).cast("long")
    rows = rows.distinct().withColumn("block", block)
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    inside = W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    own = rows.withColumn("rank", F.row_number().over(inside))
    both = own.join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return both.select("conv_id", "block", (F.col("base") + F.col("rank")).alias("number"), "role", "text")


def _hashes() -> list[Column]:
    parts = ["number", "role", "text"]
    return [F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2")]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``(conv_id, number, p1, p2)``: the rolling hash of every prefix of ``number`` turns."""
    hashed = turns.select("conv_id", "block", "number", *_hashes())
    blocks = hashed.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = blocks.select(
        F.col("conv_id").alias("c"),
        F.col("block").alias("b"),
        *[F.coalesce(F.bit_xor(f"x{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)],
    )
    inside = W.partitionBy("conv_id", "block").orderBy("number").rowsBetween(W.unboundedPreceding, W.currentRow)
    rolled = hashed.select("conv_id", "block", "number", *[F.bit_xor(f"h{i}").over(inside).alias(f"x{i}") for i in (1, 2)])
    both = rolled.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return both.select("conv_id", "number", *[F.col(f"x{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"p{i}") for i in (1, 2)])


def collapse(conversations: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_absorbed, rendered)`` of the conversations that prefix no longer one.

    ``conversations(conv_id, turn, role, text)``; turns are ordered by ``turn`` (null last), then
    role and text; rows repeated whole count once; null roles and texts count as empty; the rows
    with a null id are one conversation.  ``n_absorbed`` counts the equal conversations that this
    one stands for, itself left out.  Other columns are ignored; an empty table gives an empty one.
    """
    turns = stored(_numbered(conversations), "turns")
    prefixes = stored(prefix_hashes(turns), "prefixes")
    lengths = prefixes.groupBy("conv_id").agg(F.max("number").alias("n_turns"))
    key = ["number", "p1", "p2"]
    lengths = lengths.withColumnRenamed("conv_id", "c")
    sized = prefixes.join(lengths, F.col("conv_id").eqNullSafe(F.col("c")))
    whole = sized.where("number = n_turns").select("conv_id", *key)
    # Equal conversations: one row each, whatever their number.
    distinct = whole.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), (F.count(F.lit(1)) - 1).alias("n_absorbed"))
    inner = sized.where("number < n_turns").select(*key).distinct()
    maximal = distinct.join(inner, key, "left_anti").select(F.col("conv_id").alias("kept"), "n_absorbed")
    kept = turns.join(maximal, F.col("conv_id").eqNullSafe(F.col("kept")))
    shown = F.concat(F.lit(BEFORE_ROLE), "role", F.lit(AFTER_ROLE), "text", F.lit(AFTER_TEXT))
    parts = kept.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.first("n_absorbed").alias("n_absorbed"),
        F.array_sort(F.collect_list(F.struct("number", shown.alias("shown")))).alias("parts"),
    )
    return parts.select("conv_id", "n_turns", "n_absorbed", F.array_join("parts.shown", "").alias("rendered"))


SQL = f"""
    WITH t AS MATERIALIZED (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
    n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS number FROM t),
    p AS MATERIALIZED (SELECT conv_id, number, string_agg(md5(role || chr(1) || text), ',') OVER
        (PARTITION BY conv_id ORDER BY number ROWS UNBOUNDED PRECEDING) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM n),
    w AS (SELECT min(conv_id) AS conv_id, count(*) - 1 AS n_absorbed, prefix FROM p WHERE number = n_turns GROUP BY prefix),
    m AS (SELECT * FROM w WHERE prefix NOT IN (SELECT prefix FROM p WHERE number < n_turns))
    SELECT m.conv_id, count(*) AS n_turns, any_value(n_absorbed) AS n_absorbed, string_agg('{BEFORE_ROLE}' || role || '{AFTER_ROLE}'
        || text || '{AFTER_TEXT}', '' ORDER BY number) AS rendered
    FROM m JOIN n ON m.conv_id = n.conv_id GROUP BY m.conv_id"""
