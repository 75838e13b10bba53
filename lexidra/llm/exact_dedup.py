"""Exact duplicates of a new batch against an immutable snapshot and within itself.

The snapshot keeps one row for each text, found by the digest of its normalised bytes, and a
static binary-fuse filter for each bucket of digests.  The batch is grouped by digest on its own
first; its digests are then screened by the filters.  Only positives meet the exact rows of the
snapshot.  Wherever several rows share a digest, their bytes are compared; rows whose digests
agree but whose bytes do not are grouped by the bytes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexidra.llm import fuse
from lexidra.llm.tables import named, slices, stored, utf8

#: Characters that do not count.
WHITE = b" \t\n\x0b\x0c\r"
BUCKET_KEYS = 1 << 16
# Digests handed to every task at most: 32 MB.
SHIPPED_DIGESTS = 1 << 20


def _digests(docs: DataFrame, incoming: Column, digest_bytes: int, with_text: bool) -> DataFrame:
    """A row for each document: its id, size, digests and address, and its normalised bytes if asked for."""
    text = [("text", pa.binary())] if with_text else []
    schema = pa.schema(
        [("doc_id", pa.int64()), ("incoming", pa.bool_()), ("points", pa.int64()), ("sha", pa.binary()), ("digest", pa.binary())]
        + [("part", pa.int64()), ("pos", pa.int64())]
        + text
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, 1024):
                data = [t.translate(None, WHITE) for t in utf8(batch.column(3))]
                sha = [hashlib.sha256(d).digest() for d in data]
                n = len(data)
                address = [pa.array([part] * n, pa.int64()), pa.array(range(pos, pos + n), pa.int64())]
                short = pa.array([s[:digest_bytes] for s in sha], pa.binary())
                columns = [*batch.columns[:3], pa.array(sha, pa.binary()), short, *address]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(data, pa.binary())] if with_text else []), schema=schema)
                pos += n

    names = "doc_id long, incoming boolean, points long, sha binary, digest binary, part long, pos long"
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("points")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), incoming.alias("incoming"), size, "text")
    return rows.mapInArrow(run, names + (", text binary" if with_text else ""))


def _best() -> Column:
    """Of a group, the row with the longest original text, then the smallest id, then the first one."""
    order = [(-F.col("points")).alias("rank"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "part", "pos"]
    return F.min(F.struct(*order)).alias("best")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket")


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    """The first eight bytes of each digest."""
    return np.frombuffer(b"".join(d[:8].ljust(8, b"\0") for d in column.to_pylist()), dtype=np.uint64)


def snapshot_filters(classes: DataFrame, buckets: int) -> DataFrame:
    """A binary-fuse filter for each bucket of ``classes(digest)``."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        seed, segment, segments, cells = fuse.build(_keys(group.column("digest")))
        return pa.table({"bucket": [key[0].as_py()], "seed": [seed], "segment": [segment], "segments": [segments], "cells": pa.array([cells], pa.binary())})

    schema = "bucket long, seed long, segment long, segments long, cells binary"
    return classes.select(_bucket(buckets), "digest").groupBy("bucket").applyInArrow(run, schema)


def screened(classes: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The digests of ``classes`` that the filters do not rule out."""

    def run(key: tuple[pa.Scalar, ...], batch: pa.Table, held: pa.Table) -> pa.Table:
        own = held.to_pylist()
        digests = batch.column("digest").combine_chunks()
        hit = np.zeros(len(digests), dtype=bool)
        if own and len(digests):
            hit = fuse.contains(_keys(batch.column("digest")), *[own[0][c] for c in ("seed", "segment", "segments", "cells")])
        return pa.table({"digest": digests.filter(pa.array(hit))})

    left = classes.select(_bucket(buckets), "digest").groupBy("bucket")
    return left.cogroup(filters.groupBy("bucket")).applyInArrow(run, "digest binary")


def _semi(rows: DataFrame, digests: DataFrame, n: int) -> DataFrame:
    """Rows whose digest is listed; the list is shipped when its ``n`` digests stay below the bound."""
    return rows.join(F.broadcast(digests) if n <= SHIPPED_DIGESTS else digests, "digest", "left_semi")


def exact_groups(docs: DataFrame, incoming: Column, digest_bytes: int = 32) -> DataFrame:
    """Groups of equal texts over a snapshot and a batch of ``docs(doc_id, text)``.

    ``incoming`` tells the rows of the batch.  Returns, for every row, ``doc_id, keep_id,
    group_size, kept, text_sha256``.  Texts are equal when they are identical after deleting
    ASCII white space; null counts as empty.  The longest original text stays, then the smallest
    id (null last); of rows repeated whole exactly one is kept.  Other columns are ignored; an
    empty table gives an empty one.
    """
    plain = named(docs, "doc_id", "text")
    rows = stored(_digests(plain, incoming, digest_bytes, with_text=False), "digests")
    grouped = rows.groupBy("incoming", "digest").agg(F.count(F.lit(1)).alias("n"), _best())
    grouped = stored(grouped, "digest-classes")
    snapshot, batch = (grouped.where(F.col("incoming") == new).drop("incoming") for new in (False, True))
    sizes = {r["incoming"]: r["n"] for r in grouped.groupBy("incoming").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = max(1, -(-max(sizes.values(), default=1) // BUCKET_KEYS))
    filters = stored(snapshot_filters(snapshot, buckets), "filters")
    positive = screened(batch, filters, buckets)
    # Positives meet the exact rows; what the filter let through by mistake ends here.
    met = batch.join(positive, "digest").join(snapshot.select("digest", F.col("n").alias("n0"), F.col("best").alias("best0")), "digest")
    met = stored(met.select("digest", (F.col("n") + F.col("n0")).alias("n"), F.least("best", "best0").alias("best")), "met")
    classes = grouped.select("digest", "n", "best").join(met.select("digest"), "digest", "left_anti").unionByName(met)

    shared = stored(classes.where("n > 1").select("digest"), "shared")
    n_shared = shared.count()
    texts = _semi(_digests(plain, incoming, digest_bytes, with_text=True), shared, n_shared)
    bytes_of = texts.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    clashing = stored(bytes_of.where("low <> high").select("digest"), "clashing")
    n_clashing = clashing.count()
    out = [
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col("part") == F.col("best.part")) & (F.col("pos") == F.col("best.pos"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    ]
    if not n_clashing:
        return rows.join(classes, "digest").select("doc_id", *out)
    apart = rows.join(clashing, "digest", "left_anti").join(classes, "digest").select("doc_id", *out)
    again = stored(_semi(_digests(plain, incoming, digest_bytes, with_text=True), clashing, n_clashing), "clashing-texts")
    by_bytes = again.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), _best())
    return apart.unionByName(again.join(by_bytes, ["digest", "text"]).select("doc_id", *out))
