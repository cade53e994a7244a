"""Dense vector arithmetic on ``array<float|double>`` columns, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """``1 - a.b / (|a||b| + 1e-8)``; the epsilon makes zero vectors maximally distant."""
    return 1.0 - dot(a, b) / (norm_a * norm_b + F.lit(1e-8))


def vector_sum(column: str, width: int) -> Column:
    """Element-wise sum of arrays of a known width.

    One plain sum per element: hash aggregation with code generation and map-side combining,
    several times faster than an aggregate over vector objects.
    """
    return F.array(*[F.sum(F.col(column)[i]) for i in range(width)]).cast("array<double>")


def vector_mean(column: str, width: int) -> Column:
    return F.array(*[F.avg(F.col(column)[i].cast("double")) for i in range(width)]).cast("array<double>")


def weighted_vector_mean(column: str, weight: str, width: int) -> Column:
    total = F.sum(weight)
    return F.array(*[F.sum(F.col(column)[i] * F.col(weight)) / total for i in range(width)])
