"""Calls and long runs, from their logs: bounded retries, progress, and when mined negatives are mined anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_retries(attempts: DataFrame, key: str, at: str, retries: int, ok: str = "ok", content: str = "content", error: str = "error") -> DataFrame:
    """key, content, error, tries: the first success among a key's first `retries` + 1 attempts; without one, content is "" and error the last attempt's."""
    w = Window.partitionBy(key).orderBy(at)
    used = attempts.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= retries + 1)
    good = F.when(F.col(ok), F.col("__n"))
    found = used.groupBy(key).agg(F.min(good).alias("__good"), F.min_by(content, good).alias("content"), F.max_by(error, "__n").alias("error"), F.max("__n").alias("__all"))
    return found.select(
        key,
        F.when(F.col("__good").isNotNull(), F.col("content")).otherwise("").alias("content"),
        F.when(F.col("__good").isNull(), F.col("error")).alias("error"),
        F.coalesce("__good", "__all").alias("tries"),
    )


def progress(done: Column, total: Column, elapsed: Column, digits: int = 6) -> Column:
    """A struct of percent, rate (rows a second) and eta (seconds); no time counts as a billionth of a second."""
    rate = done / F.greatest(elapsed, F.lit(1e-9))
    return F.struct(
        F.round(100.0 * done / F.greatest(total, F.lit(1)), 1).alias("percent"),
        F.round(rate, digits).alias("rate"),
        F.round((total - done) / F.greatest(rate, F.lit(1e-9)), digits).alias("eta"),
    )


def reported(done: Column, total: Column, every: int) -> Column:
    """Whether a run says how far it is: each `every` rows and at the end."""
    return (done % every == 0) | (done == total)


def refresh_due(step: Column, last: Column, every: int) -> Column:
    """Whether negatives are mined anew at a training step; never with `every` of 0 or less, at step 0, or twice at a step."""
    return (step > 0) & (step % every == 0) & ~step.eqNullSafe(last) if every > 0 else F.lit(False)


def refreshed(steps: DataFrame, mined: DataFrame, every: int, step: str = "step", qid: str = "qid") -> DataFrame:
    """Each step with the negatives mined at its last refresh (mined: qid, point, neg; point 0 holds those from the start); a query that wasn't mined then has null."""
    point = F.col(step) - F.col(step) % every if every > 0 else F.lit(0)
    return steps.withColumn("point", point.cast("bigint")).join(mined.select(qid, F.col("point").cast("bigint").alias("point"), "neg"), [qid, "point"], "left")
