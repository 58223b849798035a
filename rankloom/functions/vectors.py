"""Expressions over ARRAY<FLOAT|DOUBLE> vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """v / |v|; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def rounded(v: Column, places: int = 6) -> Column:
    return F.transform(v, lambda x: F.round(x, places))
