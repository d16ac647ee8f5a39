"""Reports: counts, metrics by series, log averages, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelquery.functions.parse import stripped
from reelquery.operators.order import running


def categories(df: DataFrame, columns: list[str], unknown: str = "unknown") -> DataFrame:
    """field, value, n: how often each value of each column occurs; null and blank are `unknown`."""
    pairs = [F.struct(F.lit(c).alias("field"), F.coalesce(F.nullif(stripped(F.col(c).cast("string")), F.lit("")), F.lit(unknown)).alias("value")) for c in columns]
    return df.select(F.inline(F.array(*pairs))).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def length_stats(df: DataFrame, array: str, digits: int = 6) -> DataFrame:
    n = F.size(array)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), digits).alias("mean"))


def deltas(metrics: DataFrame, turn: str, names: list[str], digits: int = 6) -> DataFrame:
    """One row: each metric's value at the last turn less that at the first."""
    return metrics.agg(*[F.round(F.max_by(c, turn) - F.min_by(c, turn), digits).alias(f"delta_{c}") for c in names])


def log_averages(df: DataFrame, step: str, names: list[str], cached: list[str] = (), digits: int = 6) -> DataFrame:
    """One row: the mean of each metric over the log; metrics in `cached` first take the last value seen where they are missing."""
    filled = running(df, [step], lasts={f"__f_{c}": c for c in cached}) if cached else df
    filled = filled.select(*[F.col(f"__f_{c}" if c in cached else c).alias(c) for c in names])
    return filled.agg(*[F.round(F.avg(c), digits).alias(c) for c in names])


def exact_mean(value: Column) -> Column:
    """The mean of doubles as they are written in decimals, up to 10 places: added up exactly, so that neither the order of rows nor
    rounding decides on which side of a half it lies. Groups with a value that this can't hold get the plain mean."""
    x = value.try_cast("decimal(28,10)")
    held = F.count_if(value.isNotNull() & ~F.coalesce(x.cast("double") == value, F.lit(False))) == 0
    exact = F.try_divide(F.try_sum(x), F.count(x)).cast("double")
    return F.coalesce(F.when(held, exact), F.avg(value))


def means_in_order(df: DataFrame, by: str, ord: str, value: str, *more: Column) -> DataFrame:
    """by, mean and `more` aggregates of each group. The doubles are added up one by one in the order of `ord`, as plain SQL does
    over a table in that order, so that the mean is the same to the last bit. A group's rows are streamed through one task."""
    seen = Window.partitionBy(by).orderBy(ord).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = df.withColumns({"__total": F.sum(value).over(seen), "__at": F.count(F.lit(1)).over(seen)})
    return sums.groupBy(by).agg((F.max_by("__total", "__at") / F.count(value)).alias("mean"), *more)


def rounded(x: Column, digits: int) -> Column:
    """Doubles rounded as SQL engines in C do: scaled, rounded half away from zero, scaled back. F.round looks at the decimals that a
    double is written with, and takes 51.449999999999996 down, where its tenfold is 514.5."""
    unit = F.lit(10.0**digits)
    return F.when(F.abs(x * unit) < float("inf"), F.round(x * unit, 0) / unit).otherwise(x)


def leaderboard(df: DataFrame, metrics: dict[str, Column], by: list[str], label: str, ord: str) -> DataFrame:
    """place, label and the metrics (missing ones are 0), best first by the named metrics, then in order of input."""
    rows = df.select(label, ord, *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in metrics.items()])
    w = Window.orderBy(*[F.desc(c) for c in by], F.asc(ord))  # one row a checkpoint
    return rows.withColumn("place", F.row_number().over(w)).select("place", label, *metrics)


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A small table as Markdown (driver side)."""
    rows = df.collect()
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows)]) + "\n"
