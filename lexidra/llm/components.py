"""Connected components of an edge table, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexidra.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the smallest node of its component.

    Large-star and small-star steps alternate until nothing changes: each node's larger
    neighbours, then its smaller ones, are hung on the smallest node known there.  Rounds grow
    with the logarithm of the longest path.  A node with very many edges is aggregated before
    the shuffle and split by adaptive skew handling in the joins.  Nulls are dropped.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), F.col("a"), F.col("b"))
    e = e.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("u", "v").distinct()
    e, before = cut_lineage(e), None
    while True:
        mark = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u")))
        now = e.agg(mark.alias("m")).first()["m"]
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
