"""Vector algebra as Column expressions over ARRAY<DOUBLE>; all of it stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest norm, or product of norms, that is divided by: double epsilon.
EPS = 2.220446049250313e-16


def wide(v: Column | str) -> Column:
    """Widen to double before any arithmetic."""
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def unit(v: Column, eps: float = EPS) -> Column:
    """Row scaled to length 1; the norm is floored at eps."""
    return F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(eps)))


def cosine_distance(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """1 - cosine; a zero vector is at distance 1. Pass norms that were computed before the join."""
    return 1.0 - dot(a, b) / F.greatest((norm(a) if na is None else na) * (norm(b) if nb is None else nb), F.lit(EPS))


def euclidean_distance(a: Column, b: Column) -> Column:
    """By direct differences: equal rows are at exactly 0."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def weighted(v: Column, w: Sequence[float]) -> Column:
    return F.zip_with(v, literal(w), lambda x, y: x * y)


def project(v: Column, w: Sequence[float]) -> Column:
    return dot(v, literal(w))


def project_many(v: Column, rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*[project(v, w) for w in rows])


def product_space_distance(a: Column, b: Column, w: Sequence[float]) -> Column:
    """sqrt of the weighted sum of squared differences."""
    d = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(dot(d, literal(w)))


def chebyshev_distance(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def permuted(v: Column, order: Sequence[int]) -> Column:
    return F.array(*[F.get(v, F.lit(i)) for i in order])
