"""Expressions on embedding arrays, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if either has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1 - dot(a, b) / size).otherwise(F.lit(1.0))


def l2_distance(a: Column, b: Column) -> Column:
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def similarity(distance: Column, metric: str) -> Column:
    if metric == "cosine":
        return 1 - distance
    if metric == "l2":
        return 1 / (1 + distance)
    raise ValueError("metric is cosine or l2")
