"""Sample statistics with bias correction, as aggregates or over row frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Wrap = Callable[[Column], Column]


def _plain(c: Column) -> Column:
    return c


def skew(v: Column, over: Wrap = _plain) -> Column:
    """Adjusted Fisher-Pearson skewness; NULL below 3 values, 0 for a constant."""
    n = over(F.count(v)).cast("double")
    g1 = over(F.skewness(v))
    factor = F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    flat = over(F.min(v)) == over(F.max(v))
    return F.when(n >= 3, F.when(flat, F.lit(0.0)).otherwise(g1 * factor))


def kurt(v: Column, over: Wrap = _plain, constant: float = 0.0) -> Column:
    """Bias-corrected excess kurtosis; NULL below 4 values.

    ``constant`` is the value for equal inputs: 0 for a whole column, -3 in a
    rolling frame.
    """
    n = over(F.count(v)).cast("double")
    g2 = over(F.kurtosis(v))
    factor = (n - 1) / F.when(n > 3, (n - 2) * (n - 3))
    flat = over(F.min(v)) == over(F.max(v))
    return F.when(n >= 4, F.when(flat, F.lit(constant)).otherwise(factor * ((n + 1) * g2 + 6)))

