"""Small column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


NUDGE = 3.14159e-8


def stripped(c: Column | str) -> Column:
    """Without white space at the ends, Unicode white space included; Spark's trim takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def mean_of(values: Column) -> Column:
    """Mean of an array, NULL if it is empty."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded for results that are compared between engines, off decimal ties; -0.0 becomes 0.0."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(NUDGE), digits) + F.lit(0.0)
