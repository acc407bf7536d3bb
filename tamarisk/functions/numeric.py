"""Numeric coercion and rounding.

Rounding is half away from zero, as in SQL, and not half to even. Where a number of digits is part
of an indicator's definition, a billionth is added first, so that a mean just below a tie (in
binary) rounds like the decimal it stands for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c: Column | str) -> Column:
    """The value as a double; what is no number, and NaN, is NULL."""
    value = col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def rounded(c: Column, digits: int) -> Column:
    return F.round(c + F.lit(1e-9), digits)


def null_outside(c: Column | str, low: float, high: float) -> Column:
    """The value if it lies in [low, high], else NULL."""
    return F.when(col(c).between(low, high), col(c))


def clamped(c: Column | str, low: float, high: float) -> Column:
    """Values beyond the bounds become the bound; NULL stays NULL."""
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(low)), F.lit(high)))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return rounded(F.lit(100.0) * part / whole, digits)
