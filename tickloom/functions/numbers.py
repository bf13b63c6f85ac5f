"""Guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, otherwise: float | Column | None = 0.0) -> Column:
    """a / b where b > 0, else `otherwise`."""
    out = F.when(b > 0, F.try_divide(a, b))
    return out if otherwise is None else out.otherwise(F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise)


def change_pct(new: Column, old: Column, otherwise: float | None = 0.0) -> Column:
    return ratio((new - old) * 100, old, otherwise)


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; NULL stays NULL."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def direction(x: Column, threshold: float = 0.1) -> Column:
    return F.when(x > threshold, "UP").when(x < -threshold, "DOWN").otherwise("NEUTRAL")
