"""Distances between array columns, as built-in expressions.

Sums are taken in doubles. Vectors of unequal length raise an error; a null vector gives null. A zero vector
has a cosine distance of exactly 1 to anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = str | Callable[[Column, Column], Column]


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _doubles(x: Column | str) -> Column:
    return _col(x).cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _pairwise(a, b, f) -> Column:
    a, b = _col(a), _col(b)
    same = F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.size(a) == F.size(b), _sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), f)))
    return same.otherwise(F.raise_error(F.lit("vectors differ in dimension")).cast("double"))


def dot(a, b) -> Column:
    return _pairwise(a, b, lambda x, y: x * y)


def l2_squared(a, b) -> Column:
    """Sum of squared differences: what the metric ``l2`` ranks by."""
    return _pairwise(a, b, lambda x, y: (x - y) * (x - y))


def l2_distance(a, b) -> Column:
    return F.sqrt(l2_squared(a, b))


def inner_product_distance(a, b) -> Column:
    """The negated inner product."""
    return -dot(a, b)


def magnitude(a) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(a), lambda x: x * x)))


def cosine_distance(a, b) -> Column:
    na, nb = magnitude(a), magnitude(b)
    return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(1.0 - dot(a, b) / (na * nb))


def normalize(a, least: float = 1e-6) -> Column:
    """a divided by its magnitude, where that is above least."""
    n = magnitude(a)
    return F.when(n > least, F.transform(_doubles(a), lambda x: x / n)).otherwise(_doubles(a))


def similarity(of: Column | str) -> Column:
    """1 - distance; meaningful for cosine distances."""
    return 1.0 - _col(of)


def element(a, i: int) -> Column:
    return F.element_at(_col(a), i + 1)


def exploded(df, column: str, *keep: str):
    """A row a member of each vector: the columns kept, position (from 0) and value."""
    return df.select(*keep, F.posexplode(column).alias("position", "value"))


METRICS: dict[str, Callable] = {"l2": l2_squared, "l2_sqrt": l2_distance, "inner_product": inner_product_distance, "cosine": cosine_distance}


def distance(metric: Metric, a, b) -> Column:
    """A named metric, or any function of two columns."""
    if callable(metric):
        return metric(_col(a), _col(b))
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    return METRICS[metric](a, b)
