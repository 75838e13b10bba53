"""Ranking, ordinals and batches."""

from __future__ import annotations


from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_TOP_K = 1000


def rank_topk(
    scored: DataFrame,
    k: int = DEFAULT_TOP_K,
    group: str = "query_id",
    score: str = "score",
    tie: str = "doc_id",
    ascending: bool = False,
    spread: int = 16,
    tie_descending: bool = False,
) -> DataFrame:
    """Keep the ``k`` best rows of every group and add ``rank`` (bigint from 1).

    Ties go to the smaller ``tie`` value, or to the larger one.  A group may hold a third of all rows, so
    the cut is made twice: first inside ``spread`` hash slices of the group, then over
    the at most ``spread * k`` survivors.  No task ever sorts a whole group, for any k.
    """
    order = [F.col(score).asc() if ascending else F.col(score).desc(), F.col(tie).desc() if tie_descending else F.col(tie).asc()]
    slice_of = F.pmod(F.xxhash64(F.col(tie)), F.lit(spread))
    inner = Window.partitionBy(group, "_slice").orderBy(*order)
    outer = Window.partitionBy(group).orderBy(*order)
    survivors = (
        scored.withColumn("_slice", slice_of)
        .withColumn("_r", F.row_number().over(inner))
        .where(F.col("_r") <= k)
        .drop("_r", "_slice")
    )
    return (
        survivors.withColumn("rank", F.row_number().over(outer))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("bigint"))
    )


def with_ordinal(df: DataFrame, order_col: str, name: str = "ordinal", buckets: int | None = None) -> DataFrame:
    """Number all rows 0, 1, 2, ... in the order of the unique numeric column ``order_col`` (decimals included).

    A global window would run in one task.  Instead the key range is cut at approximate
    quantiles into parts of similar size (four per shuffle partition unless given), the
    parts are counted, and rows are numbered inside their part on top of the running
    total.  Only one count per part reaches the driver.  The numbers are exact whatever
    the quantile estimate was.
    """
    spark = df.sparkSession
    parts = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_key", F.col(order_col).cast("double"))
    edges = sorted(set(keyed.approxQuantile("_key", [i / parts for i in range(1, parts)], 0.5 / parts)))
    splits = [float("-inf"), *(edges or [0.0]), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="_key", outputCol="_part").transform(keyed).drop("_key")
    counted = placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts = list(accumulate((row["n"] for row in counted), initial=0))
    offsets = spark.createDataFrame(
        [(row["_part"], start) for row, start in zip(counted, starts)], "_part double, _start bigint"
    )
    inside = Window.partitionBy("_part").orderBy(order_col)
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - F.lit(1))
        .drop("_part", "_start")
    )


def batch_id(df: DataFrame, order_col: str, size: int, name: str = "batch_id") -> DataFrame:
    """Consecutive batches of ``size`` rows in the order of ``order_col``."""
    if size < 1:
        raise ValueError("batch size must be positive")
    numbered = with_ordinal(df, order_col, "_ordinal")
    return numbered.withColumn(name, F.floor(F.col("_ordinal") / F.lit(size)).cast("bigint")).drop("_ordinal")


def first_rows(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """The first ``n`` rows in the order of the unique column ``order_col``.

    Only the keys are numbered; the rows themselves are then filtered by the n-th key where
    they are read.
    """
    if n < 1:
        return df.limit(0)
    keys = with_ordinal(df.select(order_col), order_col, "_ordinal")
    last = keys.where(F.col("_ordinal") == n - 1).select(order_col).first()
    return df if last is None else df.where(F.col(order_col) <= F.lit(last[0]))


def name_clusters(centroids: DataFrame, token: str = "token", cluster: str = "cluster") -> DataFrame:
    """Add the dictionary name ``token_cluster``."""
    return centroids.withColumn("term", F.concat_ws("_", F.col(token), F.col(cluster).cast("string")))
