"""Vector arithmetic on ``array<double>`` columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def literal(values) -> Column:
    """An array literal of doubles."""
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))
