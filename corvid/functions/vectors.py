"""Vector functions on array columns, evaluated by the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + eps)


def squared_l2(a: Column, b: Column) -> Column:
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x)
