"""Sparsity, reconstruction, distance and latency statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexidra.functions.vectors import array_sum, as_double

NONZERO = 1e-3
# Rows of a batch per block of the distance statistic.
BLOCK_ROWS = 1024
QUANTILES = (0.5, 0.9, 0.95)
QUANTILE_ACCURACY = 10_000
UNITS = {"s": 1.0, "ms": 1e3, "us": 1e6, "ns": 1e9}


def _count(docs: DataFrame) -> Column:
    return docs.agg(F.count("*").cast("double").alias("n")).scalar()


def sparsity_stats(postings: DataFrame, docs: DataFrame, threshold: float = NONZERO) -> DataFrame:
    """One row: nonzero weights per row, exactly and above ``threshold``, averaged over **all** rows of ``docs``."""
    n = _count(docs)
    sums = postings.agg(
        F.count_if(F.col("weight") != 0).alias("exact"), F.count_if(F.abs("weight") >= threshold).alias("above")
    )
    return sums.select(
        F.try_divide(F.col("exact").cast("double"), n).alias("nonzero_per_row"),
        F.try_divide(F.col("above").cast("double"), n).alias("above_threshold_per_row"),
    )


def l1_penalty(postings: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``alpha * sum |z|``."""
    return postings.agg((F.lit(alpha) * F.coalesce(F.sum(F.abs("weight")), F.lit(0.0))).alias("l1"))


def flops_penalty(postings: DataFrame, docs: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``alpha * sum over terms of (mean |z|)^2``; the mean counts rows without the term as 0."""
    n = _count(docs)
    means = postings.groupBy("term").agg(F.try_divide(F.sum(F.abs("weight")), n).alias("m"))
    return means.agg((F.lit(alpha) * F.coalesce(F.sum(F.col("m") * F.col("m")), F.lit(0.0))).alias("flops"))


def reconstruction_mse(
    original: DataFrame, decoded: DataFrame, alpha: float = 1.0, id_col: str = "vec_id", vec_col: str = "vec"
) -> DataFrame:
    """``alpha * mean over rows and components of (x - x')^2``; one join on the id, arrays stay whole."""
    right = decoded.select(id_col, as_double(vec_col).alias("_y"))
    pairs = original.select(id_col, as_double(vec_col).alias("_x")).join(right, id_col)
    error = array_sum(F.zip_with("_x", "_y", lambda a, b: (a - b) * (a - b)))
    sums = pairs.agg(F.sum(error).alias("e"), F.sum(F.size("_x")).cast("double").alias("n"))
    return sums.select((F.lit(alpha) * F.try_divide("e", "n")).alias("mse"))


def relative_distance_distortion(
    rows: DataFrame, alpha: float = 1.0, batch: str = "batch_id", id_col: str = "vec_id", x: str = "x", z: str = "z"
) -> DataFrame:
    """Per batch: ``alpha * ||G_x - G_z||_F / n`` of the row-normalised dot-product matrices.

    ``rows(batch, id, x, z)``.  Row ``i`` of each matrix is divided by its diagonal entry; a
    zero vector makes the batch's value null.  A batch is cut into blocks of about ``BLOCK_ROWS`` rows.
    A batch of one block is multiplied as it is.  Of a larger one no pair of blocks ever meets: with
    ``w = (x, z)`` and ``u = (x / |x|^2, -z / |z|^2)``, row ``i`` adds ``u_i' (sum w w') u_i``, so one
    sum of moments and one quadratic form a row give the norm.  There, values below about 1e-7 of
    the norms of both matrices are rounding.
    """
    in_batch = rows.groupBy(batch).agg(F.count("*").alias("_n"))
    n_blocks = F.ceil(F.col("_n") / F.lit(BLOCK_ROWS))
    blocks = (
        rows.join(in_batch, batch)
        .withColumn("_block", F.pmod(F.xxhash64(id_col), n_blocks))
        .groupBy(F.col(batch).alias("batch_id"), "_n", n_blocks.alias("blocks"), "_block")
        .agg(F.collect_list(F.struct(as_double(x).alias("x"), as_double(z).alias("z"))).alias("p"))
        .select("batch_id", F.col("_n").alias("n"), "blocks", F.size("p").alias("m"), F.flatten("p.x").alias("x"), F.flatten("p.z").alias("z"))
    )
    single, several = blocks.where("blocks = 1"), blocks.where("blocks > 1")
    kind = rows.schema[batch].dataType.simpleString()
    moments = several.mapInArrow(_moments, f"batch_id {kind}, place int, value double")
    # Sums of d x d numbers, combined before the shuffle.
    summed = moments.groupBy("batch_id", "place").agg(F.sum("value").alias("value"))
    packed = F.array_sort(F.collect_list(F.struct("place", "value")))
    matrices = summed.groupBy("batch_id").agg(packed.alias("p")).select("batch_id", F.col("p.value").alias("moments"))
    squares = f"batch_id {kind}, n bigint, s double"
    met = several.join(matrices, "batch_id")
    both = single.withColumn("moments", F.lit(None).cast("array<double>")).unionByName(met).mapInArrow(_squares, squares)
    total = F.when(F.count_if(F.col("s").isNull()) == 0, F.sum("s"))
    return both.groupBy("batch_id", "n").agg(total.alias("s")).select(
        "batch_id", (F.lit(alpha) * F.sqrt("s") / F.col("n")).alias("distortion")
    )


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(batch_id, place, value)``: the entries of ``sum w w'`` over the rows of a block, row by row."""
    for part in batches:
        for i in range(part.num_rows):
            w = np.hstack([_rows(part, i, name, "m") for name in ("x", "z")])
            values = (w.T @ w).ravel()
            ids = part.column("batch_id").take(pa.array(np.full(len(values), i)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["batch_id", "place", "value"]
            )


def _squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Squared differences in the rows of a block: against itself, or by the moments of its batch."""
    for part in batches:
        out = []
        for i in range(part.num_rows):
            xs, zs = (_rows(part, i, name, "m") for name in ("x", "z"))
            dx, dz = (xs * xs).sum(axis=1, keepdims=True), (zs * zs).sum(axis=1, keepdims=True)
            if (dx == 0).any() or (dz == 0).any():
                out.append(None)
            elif part.column("moments").is_null()[i].as_py():
                difference = (xs @ xs.T) / dx - (zs @ zs.T) / dz
                out.append(float((difference * difference).sum()))
            else:
                u = np.hstack([xs / dx, -zs / dz])
                sums = part.column("moments")[i].values.to_numpy(zero_copy_only=False).reshape(u.shape[1], -1)
                out.append(float(np.maximum(((u @ sums) * u).sum(axis=1), 0.0).sum()))
        yield pa.RecordBatch.from_arrays(
            [part.column("batch_id"), part.column("n"), pa.array(out, pa.float64())], names=["batch_id", "n", "s"]
        )


def _rows(part: pa.RecordBatch, i: int, name: str, size: str) -> np.ndarray:
    """Matrix of the flattened vectors in column ``name`` of row ``i``."""
    return part.column(name)[i].values.to_numpy(zero_copy_only=False).reshape(part.column(size)[i].as_py(), -1)


def diag_gaussian_logpdf(rows: DataFrame, reduce: bool = True, id_col: str = "vec_id") -> DataFrame:
    """Log density of ``(id, dim, x, mu, v)`` under a diagonal normal, per row or per component."""
    density = F.lit(-0.5) * (
        F.lit(math.log(2.0 * math.pi)) + F.log("v") + (F.col("x") - F.col("mu")) * (F.col("x") - F.col("mu")) / F.col("v")
    )
    each = rows.select(id_col, "dim", density.alias("logpdf"))
    return each.groupBy(id_col).agg(F.sum("logpdf").alias("logpdf")) if reduce else each


def latent_staleness(activations: DataFrame, latents: DataFrame, n_batches: int) -> DataFrame:
    """Batches since each latent was last nonzero: ``(latent, staleness)``.

    ``activations(latent, batch, weight)`` with batches numbered ``0 .. n_batches - 1``.  1 means
    active in the newest batch; a latent that never fired counts all batches.
    """
    last = activations.where(F.col("weight") != 0).groupBy("latent").agg(F.max("batch").alias("last"))
    age = F.lit(n_batches).cast("bigint") - F.coalesce("last", F.lit(0))
    return latents.select("latent").join(last, "latent", "left").select("latent", age.cast("bigint").alias("staleness"))


def epoch_means(steps: DataFrame, metrics: list[str], epoch: str = "epoch") -> DataFrame:
    """Mean of every metric over the steps of an epoch."""
    return steps.groupBy(epoch).agg(*[F.avg(m).alias(m) for m in metrics])


def exact_quantiles(samples: DataFrame, group: str, value: str, probabilities: tuple[float, ...]) -> DataFrame:
    """``(group, q, quantile)`` with linear interpolation, exact for groups of any size.

    The built-in exact percentile keeps all distinct values of a group in one task.  Here an
    approximate quantile sketch brackets each wanted rank, rows below the bracket are only
    counted, and equal values inside it collapse on the map side; what is ordered per group
    is about ``4 / QUANTILE_ACCURACY`` of it.  Groups below ``QUANTILE_ACCURACY`` rows are
    ordered whole.
    """
    margin = 2.0 / QUANTILE_ACCURACY
    low = F.percentile_approx(value, [max(0.0, q - margin) for q in probabilities], QUANTILE_ACCURACY)
    high = F.percentile_approx(value, [min(1.0, q + margin) for q in probabilities], QUANTILE_ACCURACY)
    summary = samples.groupBy(group).agg(
        F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), low.alias("lo"), high.alias("hi")
    )
    small = F.col("n") <= QUANTILE_ACCURACY
    wanted = F.array(
        *[
            F.struct(
                F.lit(float(q)).alias("q"),
                F.when(small, F.col("least")).otherwise(F.col("lo")[i]).alias("lo"),
                F.when(small, F.col("most")).otherwise(F.col("hi")[i]).alias("hi"),
            )
            for i, q in enumerate(probabilities)
        ]
    )
    brackets = summary.select(group, "n", wanted.alias("wanted"))
    counted = samples.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    tested = counted.join(brackets, group).select(group, "n", "v", "c", F.explode("wanted").alias("w"))
    # Everything below a bracket collapses into one row per group and bracket.
    inside = F.when(F.col("v") >= F.col("w.lo"), F.col("v"))
    kept = (
        tested.where(F.col("v") <= F.col("w.hi"))
        .groupBy(group, "n", F.col("w.q").alias("q"), inside.alias("v"))
        .agg(F.sum("c").alias("c"))
    )
    running = Window.partitionBy(group, "q").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = kept.withColumn("upto", F.sum("c").over(running)).where(F.col("v").isNotNull())
    place = F.col("q") * (F.col("n") - F.lit(1))
    bounds = ranked.groupBy(group, "q", "n").agg(
        F.min(F.when(F.col("upto") > F.floor(place), F.col("v"))).alias("a"),
        F.min(F.when(F.col("upto") > F.ceil(place), F.col("v"))).alias("b"),
    )
    return bounds.select(group, "q", (F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place))).alias("quantile"))


def latency_stats(
    samples: DataFrame, confidence: float = 0.95, unit: str = "ms", bench: str = "bench", seconds: str = "seconds"
) -> DataFrame:
    """Per bench: ``n, mean, std, ci_low, ci_high, p50, p90, p95`` in ``unit``."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}, expected one of {sorted(UNITS)}")
    if not 0 < confidence <= 1:
        raise ValueError("confidence must lie in (0, 1]")
    scale = F.lit(UNITS[unit])
    z = F.lit(NormalDist().inv_cdf((1.0 + confidence) / 2.0) if confidence < 1 else math.inf)
    moments = samples.groupBy(bench).agg(
        F.count(seconds).alias("n"), F.avg(seconds).alias("mean"), F.stddev_samp(seconds).alias("std")
    )
    quantiles = exact_quantiles(samples, bench, seconds, QUANTILES)
    wide = quantiles.groupBy(bench).agg(
        *[F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(f"p{round(q * 100)}") for q in QUANTILES]
    )
    half = z * F.col("std") / F.sqrt(F.col("n").cast("double"))
    return moments.join(wide, bench).select(
        bench,
        "n",
        (F.col("mean") * scale).alias("mean"),
        (F.col("std") * scale).alias("std"),
        ((F.col("mean") - half) * scale).alias("ci_low"),
        ((F.col("mean") + half) * scale).alias("ci_high"),
        *[(F.col(f"p{round(q * 100)}") * scale).alias(f"p{round(q * 100)}") for q in QUANTILES],
    )
