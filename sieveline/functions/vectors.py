"""Column builders over ARRAY<DOUBLE> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x * y))


def minkowski(a: Column, b: Column, p: float = 2.0) -> Column:
    if p == 2.0:
        return F.sqrt(_fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    return F.pow(_fold(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1.0 / p))


def bits(v: Column, threshold: float = 0.0) -> Column:
    """A binary fingerprint: 1 where the feature is above threshold."""
    return F.transform(v, lambda x: F.when(x > threshold, 1.0).otherwise(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)
