"""Vector arithmetic on ARRAY columns, in DOUBLE, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(a: Column, floor: float = 0.0) -> Column:
    """``a / max(|a|, floor)``; a zero vector without a floor gives nulls."""
    length = F.greatest(norm(a), F.lit(floor))
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), length))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))
