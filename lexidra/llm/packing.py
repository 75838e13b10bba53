"""Harmonic packing of token ids into sequences of a fixed capacity.

Class ``k`` takes pieces of exactly ``capacity // k`` tokens, and ``k`` of them fill a sequence.
Documents may be cut, so every remainder is written as a sum of class sizes with as few pieces
as possible; nothing is rounded up.  Workers number their pieces class by class on their own;
the counts of the workers, added up per class, turn these numbers into sequences.  What is left
of each class, less than one sequence, goes into common sequences, largest piece first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexidra.llm.bpe import encoder
from lexidra.llm.tables import named, stored, strings

CAPACITY = 2048
END_ID = 1
# A token of padding counts as this share of a cut.
PADDING_COST = 0.05


def class_of_size(capacity: int) -> dict[int, int]:
    """Size of a piece -> its class, the number of such pieces in a sequence."""
    return {capacity // k: k for k in range(capacity, 0, -1)}


def next_piece(capacity: int) -> np.ndarray:
    """For every length up to ``capacity``, the first piece of its cheapest sum of class sizes."""
    sizes = np.array(sorted(class_of_size(capacity)), dtype=np.int64)
    classes = capacity // sizes
    price = 1 + PADDING_COST * (capacity - classes * sizes) / classes
    cost, first = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for length in range(1, capacity + 1):
        usable = sizes <= length
        total = cost[length - sizes[usable]] + price[usable]
        best = len(total) - 1 - int(np.argmin(total[::-1]))
        cost[length], first[length] = total[best], sizes[best]
    return first


def piece_lengths(length: int, first: np.ndarray) -> list[int]:
    """Lengths of the pieces of a document below the capacity, longest first; ``first`` is from ``next_piece``."""
    out = []
    while length:
        out.append(int(first[length]))
        length -= out[-1]
    return sorted(out, reverse=True)


def _cutter(path: str, capacity: int):
    schema = pa.schema(
        [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "worker", "class", "rank")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, classes, first, ranks = encoder(path).parts, class_of_size(capacity), next_piece(capacity), {}
        worker = TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                own, start = [], 0
                held = np.empty(0, dtype="<u4")

                def cut(length: int) -> None:
                    nonlocal held, start
                    k = classes[length]
                    ranks[k] = ranks.get(k, -1) + 1
                    own.append((start, length, zlib.crc32(held[:length].tobytes()), k, ranks[k]))
                    held, start = held[length:], start + length

                for ids in parts(text):
                    held = np.concatenate([held, ids.astype("<u4", copy=False)])
                    while len(held) >= capacity:
                        cut(capacity)
                held = np.append(held, np.array([END_ID], dtype="<u4"))
                for length in piece_lengths(len(held), first):
                    cut(length)
                rows += [(doc, a, n, crc, start, worker, k, r) for a, n, crc, k, r in own]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
                )

    return run


def close_classes(counts: dict[int, int], capacity: int) -> tuple[dict[int, int], list[tuple[int, int, int, int]]]:
    """Place whole classes and what is left of them.

    ``counts`` has the pieces of each class.  Returns the first sequence of each class and, for
    every piece beyond the last full sequence, ``(class, number, sequence, offset)``.  The
    result has less than ``capacity // k * k`` tokens for each class ``k``, so its size depends
    on the capacity only.
    """
    first, used = {}, 0
    for k in sorted(counts):
        first[k], used = used, used + counts[k] // k
    open_bins: list[int] = []
    placed = []
    for k in sorted(counts):
        for number in range(counts[k] // k * k, counts[k]):
            size = capacity // k
            spot = next((i for i, fill in enumerate(open_bins) if fill + size <= capacity), len(open_bins))
            if spot == len(open_bins):
                open_bins.append(0)
            placed.append((k, number, used + spot, open_bins[spot]))
            open_bins[spot] += size
    return first, placed


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents ``(doc_id, text)`` and their places in sequences of ``capacity`` ids.

    Columns: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.  A document is
    its ids and ``END_ID``; a null or empty text is ``END_ID`` alone.  Repeated rows and null ids
    are packed like any other row; other columns are ignored; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    rows = named(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stored(
        rows.mapInArrow(
            _cutter(path, capacity),
            "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker long, class long, rank long",
        ),
        "pieces",
    )
    by_worker = pieces.groupBy("worker", "class").agg((F.max("rank") + 1).alias("n"))
    earlier = W.partitionBy("class").orderBy("worker").rowsBetween(W.unboundedPreceding, -1)
    bases = by_worker.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # One row for each class: there are about 2 * sqrt(capacity) of them.
    counts = {r["class"]: r["n"] for r in by_worker.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    first, placed = close_classes(counts, capacity)
    starts = spark.createDataFrame(sorted((k, first[k], counts[k] // k * k) for k in counts), "class long, first long, whole long")
    rest = spark.createDataFrame(placed, "class long, number long, rest_sequence long, rest_offset long")
    numbered = pieces.join(bases.drop("n"), ["worker", "class"]).withColumn("number", F.col("base") + F.col("rank"))
    inside = numbered.join(F.broadcast(starts), "class").join(F.broadcast(rest), ["class", "number"], "left")
    whole = F.col("number") < F.col("whole")
    return inside.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.when(whole, F.col("first") + F.floor(F.col("number") / F.col("class"))).otherwise(F.col("rest_sequence")).alias("sequence_id"),
        F.when(whole, (F.col("number") % F.col("class")) * F.col("length")).otherwise(F.col("rest_offset")).alias("offset"),
    )
