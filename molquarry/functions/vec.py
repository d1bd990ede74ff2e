"""Vector expressions over array columns; everything stays in the JVM and computes in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def l2_normalize(a: Column, eps: float = EPS) -> Column:
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda x: x / n)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def similarity(a: Column, b: Column, metric: str = "cosine", temperature: float = 1.0) -> Column:
    """Similarity of two vectors divided by the temperature; euclidean is negated, an unknown metric refused."""
    if metric == "cosine":
        s = dot(l2_normalize(a), l2_normalize(b))
    elif metric == "euclidean":
        s = -norm(F.zip_with(a, b, lambda x, y: x - y))
    elif metric == "dot":
        s = dot(a, b)
    else:
        raise ValueError(f"unknown metric {metric}")
    return s / F.lit(float(temperature))
