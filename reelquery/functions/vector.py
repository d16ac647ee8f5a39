"""Vectors as array columns: dot products, norms and residual updates, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed from left to right in double precision."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column, how: str = "clip") -> Column:
    """Scales to length 1. how: `clip` divides by at least 1e-12, `add` by the norm plus 1e-9, `keep` leaves vectors shorter than 1e-12 alone, `plain` divides by the norm."""
    v = doubles(v)
    n = norm(v)
    by = {"clip": F.greatest(n, F.lit(1e-12)), "add": n + 1e-9, "keep": F.when(n < 1e-12, F.lit(1.0)).otherwise(n), "plain": n}[how]
    return F.transform(v, lambda x: x / by)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def mean_vector(rows: Column) -> Column:
    """Component-wise mean of an array of vectors."""
    total = F.aggregate(F.slice(rows, 2, F.size(rows)), doubles(F.element_at(rows, 1)), lambda acc, v: plus(acc, v))
    return F.transform(total, lambda x: x / F.size(rows))


def residual_update(query: Column, update: Column) -> Column:
    """The query moved by the mean of its update rows, scaled to length 1."""
    return normalize(plus(query, mean_vector(update)))


def neighbour_cosines(rows: Column) -> Column:
    """Cosine of each vector of an array with the next one."""
    head = F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0)))
    return F.zip_with(head, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), cosine)
