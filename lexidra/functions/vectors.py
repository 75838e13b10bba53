"""Vector columns: arrays of doubles handled inside the row, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vec: Column | str) -> Column:
    return (F.col(vec) if isinstance(vec, str) else vec).cast("array<double>")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A plain column that a lambda refers to may be inlined into it by the optimizer and would
    then be computed again for every element.
    """
    return F.transform(F.array(value), use)[0]


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(left: Column, right: Column) -> Column:
    return array_sum(F.zip_with(left, right, lambda a, b: a * b))


def squared_distance(left: Column, right: Column) -> Column:
    return array_sum(F.zip_with(left, right, lambda a, b: (a - b) * (a - b)))


def one_hot(index: Column, size: int) -> Column:
    """Array of ``size`` doubles with a single 1 at ``index``."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def component_sums(vec: str, dim: int, weight: Column | None = None) -> list[Column]:
    """One partial-aggregable sum per component, named ``c0 .. c{dim-1}``."""
    factor = F.lit(1.0) if weight is None else weight
    return [F.sum(F.col(vec)[i] * factor).alias(f"c{i}") for i in range(dim)]
