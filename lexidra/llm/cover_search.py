"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt to the nearest of a few centres, the top of both trees; a crowded centre is
many blocks.  Queries and data have blocks of their own, each with its centre and covering
radius.  Every group of queries first searches the blocks with the highest bounds, which gives
each query a k-th score.  A pair of nodes whose bound, from both centres and radii, lies below
the worst k-th score of its queries is pruned: first pairs of blocks, before any vector is sent,
then pairs of nodes of the cover trees inside the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexidra.llm.tables import named, stored

BLOCK = 4096
QUERY_BLOCK = 512
# Vectors from which centres are drawn at most: those with the smallest hashes.
SAMPLE = 2048
MOST_CENTRES = 256
# Query blocks that meet a data block in one task at most, and blocks searched first.
TASK_QUERIES = 32
FIRST_BLOCKS = 2
LEAF = 64
SHRINK = 1.3
EXACT = 2**53
# Below every score; its negative is a number too.
LOWEST = 1 - 2**63

BLOCK_KEY = ("dim", "cell", "sub")
HITS = "q long, query_row long, query_id long, row_id long, vec_id long, score long"


def _prepared(vectors: DataFrame, scale: int) -> DataFrame:
    """``(row_id, vec_id, dim, vec)`` of the rows that take part; ``vec`` holds 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, vec, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.array(values, dtype=np.float64)
                if not np.isfinite(x).all():
                    continue
                scaled = np.floor(scale * x)
                if len(x) and np.abs(scaled).max() * np.abs(scaled).max() * len(x) >= 2.0**63:
                    raise OverflowError(f"the scores of vector {vec} do not fit in 64 bits")
                out.append((row, vec, len(x), scaled.astype("<i8").tobytes()))
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row_id", "vec_id", "dim", "vec"])

    rows = named(vectors, "vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.where(~F.exists("embedding", lambda x: x.isNull()))
    rows = rows.select(F.monotonically_increasing_id().alias("row_id"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
    return stored(rows.mapInArrow(run, "row_id long, vec_id long, dim int, vec binary"), "vectors")


def cover(points: np.ndarray, radius: float, most: int) -> list[np.ndarray]:
    """Greedy cover: the first point left is the next centre and takes all within ``radius``.

    After ``most`` centres the rest stays together behind one more.
    """
    left, out = np.arange(len(points)), []
    while len(left) and len(out) < most:
        near = ((points[left] - points[left[0]]) ** 2).sum(axis=1) <= radius * radius
        out.append(left[near])
        left = left[~near]
    return out + ([left] if len(left) else [])


class Node:
    """A node of a cover tree: a centre, the radius that covers its points, and its children."""

    def __init__(self, points: np.ndarray, members: np.ndarray, leaf: int) -> None:
        self.members = members
        own = points[members]
        self.centre = own[0]
        self.length = float(np.sqrt((self.centre**2).sum()))
        self.radius = float(np.sqrt(((own - self.centre) ** 2).sum(axis=1).max()))
        self.children: list[Node] = []
        if len(members) > leaf and self.radius > 0:
            parts = cover(own, self.radius / SHRINK, 2 * (len(members) // leaf) + 2)
            if len(parts) > 1 and max(map(len, parts)) < len(members):
                self.children = [Node(points, members[p], leaf) for p in _gathered(parts, leaf)]


def _gathered(parts: list[np.ndarray], leaf: int) -> list[np.ndarray]:
    """Neighbouring small parts of a cover as one, so that nodes are worth a product."""
    out: list[np.ndarray] = []
    for part in parts:
        if out and len(out[-1]) + len(part) <= leaf:
            out[-1] = np.concatenate([out[-1], part])
        else:
            out.append(part)
    return out


def bound(a_centre: np.ndarray, a_radius, b_centre: np.ndarray, b_radius) -> np.ndarray:
    """The largest inner product that points of two balls can have, rounding included."""
    a, b = np.sqrt((a_centre**2).sum(axis=-1)), np.sqrt((b_centre**2).sum(axis=-1))
    value = (a_centre * b_centre).sum(axis=-1) + a_radius * b + b_radius * a + a_radius * b_radius
    return value + 1e-9 * (a + a_radius) * (b + b_radius) + 1e-6


class Best:
    """The k best of every query so far: scores, ids and rows, best first."""

    def __init__(self, queries: int, k: int) -> None:
        self.score = np.full((queries, k), LOWEST)
        self.vec = np.full((queries, k), np.iinfo(np.int64).max)
        self.row = np.full((queries, k), -1)

    def offer(self, q: np.ndarray, score: np.ndarray, vec: np.ndarray, row: np.ndarray) -> None:
        score = np.hstack([self.score[q], score])
        vec = np.hstack([self.vec[q], np.broadcast_to(vec, (len(q), len(vec)))])
        row = np.hstack([self.row[q], np.broadcast_to(row, (len(q), len(row)))])
        order = np.lexsort((row, vec, -score), axis=-1)[:, : self.score.shape[1]]
        for name, values in (("score", score), ("vec", vec), ("row", row)):
            getattr(self, name)[q] = np.take_along_axis(values, order, axis=1)


def dual_search(queries: Packed, data: Packed, known: np.ndarray, k: int) -> Best:
    """Search all ``queries`` in ``data``; ``known`` has a k-th score of each query from elsewhere."""
    best = Best(len(queries.rows), k)
    if not len(queries.rows) or not len(data.rows):
        return best
    exact = float(np.abs(queries.points).max(initial=0)) * float(np.abs(data.points).max(initial=0)) * max(1, queries.points.shape[1]) < EXACT
    everything = [np.arange(len(p.rows)) for p in (queries, data)]
    stack = [(Node(queries.points, everything[0], LEAF), Node(data.points, everything[1], LEAF))]
    while stack:
        a, b = stack.pop()
        worst = np.maximum(best.score[a.members, -1], known[a.members])
        if bound(a.centre, a.radius, b.centre, b.radius) < worst.min():
            continue
        if a.children or b.children:
            pairs = [(x, y) for x in a.children or [a] for y in b.children or [b]]
            # The most promising pair is searched first, so the others meet higher scores.
            stack += sorted(pairs, key=lambda p: float(bound(p[0].centre, p[0].radius, p[1].centre, p[1].radius)))
            continue
        if exact:
            score = (queries.points[a.members] @ data.points[b.members].T).astype(np.int64)
        else:
            score = queries.whole[a.members] @ data.whole[b.members].T
        own = queries.rows[a.members][:, None] == data.rows[b.members][None, :]
        score[own] = LOWEST
        useful = ((score >= worst[:, None]) & ~own).any(axis=0)
        if useful.any():
            at = b.members[useful]
            best.offer(a.members, score[:, useful], data.vecs[at], data.rows[at])
    mine = best.row == queries.rows[:, None]
    best.row[mine | (best.score < known[:, None])] = -1
    return best


class Packed:
    """The vectors of a block."""

    def __init__(self, rows: np.ndarray, vecs: np.ndarray, whole: np.ndarray) -> None:
        self.rows, self.vecs, self.whole = rows, vecs, whole
        self.points = whole.astype(np.float64)

    def to_bytes(self) -> bytes:
        return b"".join(x.astype("<i8").tobytes() for x in (self.rows, self.vecs, self.whole))

    @classmethod
    def from_bytes(cls, data: bytes, n: int) -> Packed:
        flat = np.frombuffer(data, dtype="<i8")
        return cls(flat[:n], flat[n : 2 * n], flat[2 * n :].reshape(n, -1))


def _centres(rows: DataFrame, counts: dict[int, int]) -> dict[int, np.ndarray]:
    """Centres of the cells of each dimension, from a bounded sample."""
    sample = rows.select("dim", "vec").orderBy(F.xxhash64("row_id", "vec"), "row_id").limit(SAMPLE).collect()
    out = {}
    for dim in {r["dim"] for r in sample}:
        own = [np.frombuffer(r["vec"], dtype="<i8") for r in sample if r["dim"] == dim]
        points = np.array(own, dtype=np.float64).reshape(len(own), dim)
        wanted = min(MOST_CENTRES, max(1, -(-counts[dim] // BLOCK)))
        # The level of the cover tree that has about as many nodes as wanted.
        radius = Node(points, np.arange(len(points)), len(points)).radius
        while len(cover(points, radius, wanted)) < wanted and radius > 1e-6:
            radius /= SHRINK
        out[dim] = np.array([points[p[0]] for p in cover(points, radius, wanted)][:wanted])
    return out


def _celled(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cells = np.array(batch.column(2).to_pylist(), dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            raw = batch.column(3).to_pylist()
            for dim in set(dims.tolist()) & set(centres):
                at = np.flatnonzero(dims == dim)
                x = np.array([np.frombuffer(raw[i], dtype="<i8") for i in at], dtype=np.float64).reshape(len(at), dim)
                c = centres[dim]
                cells[at] = ((c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=["row_id", "vec_id", "dim", "vec", "cell"])

    return stored(rows.mapInArrow(run, "row_id long, vec_id long, dim int, vec binary, cell long"), "cells")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """``(dim, cell, sub, n, centre, radius, packed)``: the rows of each cell in blocks of about ``size``."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        dim, n = key[0].as_py(), group.num_rows
        whole = np.array([np.frombuffer(v, dtype="<i8") for v in group.column("vec").to_pylist()], dtype=np.int64).reshape(n, dim)
        packed = Packed(group.column("row_id").to_numpy(), group.column("vec_id").to_numpy(), whole)
        centre = packed.points.mean(axis=0)
        radius = float(np.sqrt(((packed.points - centre) ** 2).sum(axis=1).max()))
        columns = {c: [k.as_py()] for c, k in zip(BLOCK_KEY, key, strict=True)}
        types = pa.schema([("dim", pa.int32()), ("cell", pa.int64()), ("sub", pa.int64()), ("n", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("packed", pa.binary())])
        return pa.table(columns | {"n": [n], "centre": [centre.tolist()], "radius": [radius], "packed": [packed.to_bytes()]}, schema=types)

    sizes = rows.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"))
    parts = sizes.select("dim", "cell", F.ceil(F.col("n") / size).cast("long").alias("parts"))
    dealt = rows.join(parts, ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("row_id"), F.col("parts")))
    schema = "dim int, cell long, sub long, n long, centre array<double>, radius double, packed binary"
    return dealt.groupBy(*BLOCK_KEY).applyInArrow(run, schema).withColumn("block", F.monotonically_increasing_id())


def _bounds(queries: DataFrame, data: DataFrame, tasks: int) -> DataFrame:
    """``(q, d, most)`` for every query block and every data block of its dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = [
                float(bound(np.array(a), ar, np.array(b), br)) if len(a) else 0.0
                for a, ar, b, br in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(most, pa.float64())], names=["q", "d", "most"])

    q = queries.select("dim", F.pmod("block", F.lit(tasks)).alias("part"), F.col("block").alias("q"), F.col("centre").alias("qc"), F.col("radius").alias("qr"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long")))
    d = data.select("dim", parts.alias("part"), F.col("block").alias("d"), F.col("centre").alias("dc"), F.col("radius").alias("dr"))
    return q.join(d, ["dim", "part"]).select("q", "d", "qc", "qr", "dc", "dr").mapInArrow(run, "q long, d long, most double")


def _searched(pairs: DataFrame, queries: DataFrame, data: DataFrame, tasks: int, k: int) -> DataFrame:
    """The hits of the block pairs ``(q, d, known)``; ``known`` maps query rows to k-th scores."""

    def run(key: tuple[pa.Scalar, ...], asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ("q", "query_row", "query_id", "row_id", "vec_id", "score")
        columns: list[list[np.ndarray]] = [[np.empty(0, dtype=np.int64)] for _ in names]
        if held.num_rows:
            item = held.to_pylist()[0]
            block = Packed.from_bytes(item["packed"], item["n"])
            for row in asked.to_pylist():
                own = Packed.from_bytes(row["packed"], row["n"])
                known = {x["query_row"]: x["kth"] for x in row["known"] or []}
                least = np.array([known.get(r, LOWEST) for r in own.rows.tolist()], dtype=np.int64)
                best = dual_search(own, block, least, k)
                q, place = np.nonzero(best.row >= 0)
                found = (np.full(len(q), row["q"]), own.rows[q], own.vecs[q], best.row[q, place], best.vec[q, place], best.score[q, place])
                for column, values in zip(columns, found, strict=True):
                    column.append(values)
        return pa.table({n: pa.array(np.concatenate(c), pa.int64()) for n, c in zip(names, columns, strict=True)})

    part = F.pmod(F.col("q"), F.lit(tasks)).alias("part")
    asked = pairs.join(queries.select(F.col("block").alias("q"), "n", "packed"), "q").select("d", part, "q", "n", "packed", "known")
    wanted = pairs.select("d", part).distinct()
    held = data.select(F.col("block").alias("d"), "n", "packed").join(wanted, "d")
    return asked.groupBy("d", "part").cogroup(held.groupBy("d", "part")).applyInArrow(run, HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest inner products of every query row.

    ``vectors(vec_id, embedding)``; components are ``floor(scale * x)``.  A query's own row is no
    candidate, other rows with its id are.  Ties go to the smaller id.  Vectors that are null or
    hold null or non-finite components, and rows with a null id, take no part; vectors of
    different lengths do not meet.  Scores beyond 64 bits raise an error.  Other columns are
    ignored; an empty table gives an empty one.
    """
    rows = _prepared(vectors, scale)
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    celled = _celled(rows, _centres(rows, counts))
    data = stored(_blocks(celled, BLOCK), "data-blocks")
    queries = stored(_blocks(celled.where(is_query), QUERY_BLOCK), "query-blocks")
    tasks = max(1, -(-queries.count() // TASK_QUERIES))
    bounds = stored(_bounds(queries, data, tasks), "bounds")
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("most"), "d"))
    ordered = stored(bounds.withColumn("place", place), "block-pairs")
    nothing = F.lit(None).cast("array<struct<query_row:bigint,kth:bigint>>").alias("known")
    first = stored(_searched(ordered.where(F.col("place") <= FIRST_BLOCKS).select("q", "d", nothing), queries, data, tasks, k), "first-hits")
    # The k-th score of each query so far; a group with a query that has none yet prunes nothing.
    kth = _ranked(first, k).where(F.col("rank") == k).groupBy("q").agg(
        F.collect_list(F.struct("query_row", F.col("score").alias("kth"))).alias("known"), F.min("score").alias("worst")
    )
    sizes = queries.select(F.col("block").alias("q"), "n")
    worst = F.when(F.size("known") == F.col("n"), F.col("worst"))
    kth = kth.join(sizes, "q").select("q", "known", worst.alias("worst"))
    others = ordered.where(F.col("place") > FIRST_BLOCKS).join(kth, "q", "left")
    left = stored(others.where("worst IS NULL OR most >= worst").select("q", "d", "known"), "pairs-left")
    hits = first.unionByName(_searched(left, queries, data, tasks, k))
    return _ranked(hits, k).select("query_id", "rank", "vec_id", "score")
