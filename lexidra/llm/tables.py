"""What the operators of this package share: stored intermediates, row addresses, document rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidra.session import discard, stored  # noqa: F401


def named(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, so that no other column of ``df`` can clash with a name used later."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct; inside it their names clash with nothing."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8; null counts as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """The texts of a string column; null counts as empty."""
    return [value or "" for value in column.to_pylist()]


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows, so that temporaries stay small."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def by_bytes(batch: pa.RecordBatch, column: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts in ``column`` have at most ``most`` bytes together; a longer text is a part of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end
