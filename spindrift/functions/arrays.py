"""Array expressions: dot products, norms, distances; all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def square(a: Column) -> Column:
    return total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(square(a))


def peak_to_peak(a: Column) -> Column:
    return (F.array_max(a) - F.array_min(a)).cast("double")


def signed_log1p(x: Column, scale: float = 1.0) -> Column:
    """sign(x) * log(1 + |x| * scale)."""
    return F.signum(x) * F.log1p(F.abs(x) * scale)


def signed_sqrt(x: Column, scale: float = 1.0) -> Column:
    """sign(x) * (sqrt(1 + |x| * scale) - 1)."""
    return F.signum(x) * (F.sqrt(F.abs(x) * scale + 1) - 1)


def convexity(v: Column) -> Column:
    """Sum of products of neighbouring differences, the sign turned at the centre: high where a snippet bends one way about its middle sample."""
    n = F.size(v)
    d = F.zip_with(F.slice(v, F.lit(2), n - 1), F.slice(v, F.lit(1), n - 1), lambda b, a: b - a)
    half = F.floor((n - 1) / 2)
    turned = F.transform(d, lambda x, i: F.when(i < half, -x).otherwise(x))
    return total(F.zip_with(F.slice(turned, F.lit(2), n - 2), F.slice(turned, F.lit(1), n - 2), lambda a, b: a * b))
