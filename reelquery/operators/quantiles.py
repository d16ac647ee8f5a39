"""Exact quantiles of any number of rows in bounded memory.

A sketch of bounded size (percentile_approx) gives two values that surely enclose the wanted ranks; one pass counts what
lies below, on and between them, and the next round looks only between them. Each round leaves about 1/2000 of the rows,
and the two ends never, so it ends however the values repeat. The last `FEW` values come to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of the sketch, and values that are sorted on the driver.
ACCURACY, FEW = 10_000, 10_000


def at_ranks(df: DataFrame, value: Column, ranks: list[int]) -> dict[int, float]:
    """The values that stand at these places (from 0, neighbours of each other) of all non-null values in order; NaN is the largest."""
    rows = df.select(value.alias("v")).where("v is not null")
    n, below, out, wanted = rows.count(), 0, {}, sorted(set(ranks))
    while wanted and n > FEW:
        around = [max(0.0, (wanted[0] - below) / n - 2 / ACCURACY), min(1.0, (wanted[-1] + 1 - below) / n + 2 / ACCURACY)]
        a, b = rows.agg(F.percentile_approx("v", around, ACCURACY)).first()[0]
        v, lo, hi = F.col("v"), _like(rows, a), _like(rows, b)
        less, on_a, inner, on_b = rows.agg(F.count_if(v < lo), F.count_if(v == lo), F.count_if((v > lo) & (v < hi)), F.count_if((v == hi) & (v != lo))).first()
        first, left = below + less, []
        for r in wanted:
            if first <= r < first + on_a:
                out[r] = a
            elif first + on_a + inner <= r < first + on_a + inner + on_b:
                out[r] = b
            elif first + on_a <= r < first + on_a + inner:
                left.append(r)
            else:
                raise ArithmeticError("the sketch is worse than it says")
        rows, n, below, wanted = rows.where((v > lo) & (v < hi)), inner, first + on_a, left
    if wanted:
        found = [r[0] for r in rows.orderBy("v").collect()]  # FEW at most
        out |= {r: found[r - below] for r in wanted}
    return out


def _like(rows: DataFrame, x) -> Column:
    return F.lit(x).cast(rows.schema["v"].dataType)


def exact(df: DataFrame, value: Column, q: float) -> float | None:
    """The quantile q of the non-null values, interpolated between neighbours; None if there are none."""
    n = df.where(value.isNotNull()).count()
    if not n:
        return None
    at = (n - 1) * q
    low, high = math.floor(at), math.ceil(at)
    found = at_ranks(df, value, [low, high])
    if low == high or found[low] == found[high]:
        return float(found[low])
    return (high - at) * float(found[low]) + (at - low) * float(found[high])
