"""Order-independent sums and reproducible rounding.

Floating-point sums depend on the order in which partitions arrive, and a rank cut
turns a difference in the last bit into a different result.  Scores are therefore
summed as 64-bit fixed-point numbers with nine decimals: integer addition gives the
same total for every partitioning, retry and engine, and stays inside generated code.
Totals may reach 9.2e9; beyond that the sum raises an overflow error in ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_SCALE = 1e9
REPORT_SCALE = 1e6


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def fixed_point(value: Column | str) -> Column:
    """``value`` in units of 1e-9, rounded half up, as bigint."""
    return F.floor(_col(value).cast("double") * F.lit(SCORE_SCALE) + F.lit(0.5))


def score_sum(value: Column | str) -> Column:
    """Aggregate: exact sum of ``value`` at nine decimals."""
    return F.sum(fixed_point(value)).cast("double") / F.lit(SCORE_SCALE)


def snap(value: Column | str, scale: float = SCORE_SCALE) -> Column:
    """Round half up to the grid ``1/scale``."""
    return F.floor(_col(value) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def report(value: Column | str) -> Column:
    """Round a reported statistic to six decimals."""
    return snap(value, REPORT_SCALE)
