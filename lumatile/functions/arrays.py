"""Expressions over ARRAY<DOUBLE> traces: norms, first maxima, distances. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(a: Column) -> Column:
    """NULL and NaN as 0."""
    return F.transform(a, lambda v: F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column, order: float = 2) -> Column:
    """The Lp norm; order may be infinite."""
    if order == float("inf"):
        return F.array_max(F.transform(a, F.abs))
    if order == 1:
        return F.aggregate(a, F.lit(0.0), lambda s, v: s + F.abs(v))
    if order == 2:
        return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))
    return F.pow(F.aggregate(a, F.lit(0.0), lambda s, v: s + F.pow(F.abs(v), F.lit(float(order)))), F.lit(1.0 / order))


def normalised(a: Column, order: float, size: int) -> Column:
    """a divided by its norm; cells that are not finite afterwards become the norm of a constant 1/size vector, divided by size."""
    fill = constant_norm(order, size) / size
    n = norm(a, order)
    return F.transform(a, lambda v: F.coalesce(F.try_divide(v, n), F.lit(fill)))


def constant_norm(order: float, size: int) -> float:
    """Norm of the constant vector 1/size."""
    return size ** (1.0 / order) / size if order != float("inf") else 1.0 / size


def first_argmax(a: Column) -> Column:
    """0-based place of the first largest element."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def chunks(a: Column, rows: int, columns: int) -> Column:
    """A row-major array of rows * columns as an array of rows."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(a, i * columns + 1, F.lit(columns)))


METRICS = ("euclidean", "manhattan", "cityblock", "chebyshev", "cosine", "sqeuclidean", "hamming")


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Distance of two traces of equal length."""
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is none of {METRICS}")
    if metric == "cosine":
        return 1 - F.try_divide(total(F.zip_with(a, b, lambda x, y: x * y)), norm(a) * norm(b))
    d = F.zip_with(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0) if metric == "hamming" else F.abs(x - y))
    if metric in ("manhattan", "cityblock"):
        return total(d)
    if metric == "chebyshev":
        return F.array_max(d)
    if metric == "hamming":
        return total(d) / F.size(d)
    square = total(F.transform(d, lambda x: x * x))
    return square if metric == "sqeuclidean" else F.sqrt(square)
