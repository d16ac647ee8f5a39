"""Rewards of rollouts as column expressions, and their normalisation in groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelquery.functions.parse import has_tag, last_tag, stripped, times_last
from reelquery.functions.temporal import iou_strict, span
from reelquery.operators.quantiles import exact
from reelquery.operators.turns import final_turn


def answer_binary(turns: Column, solution: Column) -> Column:
    """1 if the final answer agrees with whether the retrieved item is the right one, else -1; 0 without turns."""
    t = final_turn(turns)
    right = (F.coalesce(t["retrieved_id"], F.lit("")) != "") & (t["retrieved_id"] == F.coalesce(solution, F.lit("")))
    label = F.when(right, "matched").otherwise("not_matched")
    return F.when(t.isNull(), 0.0).when(F.coalesce(t["answer"], F.lit("")) == label, 1.0).otherwise(-1.0)


def think_format(text: Column) -> Column:
    """1 if the last think block isn't blank."""
    return F.when(F.coalesce(stripped(last_tag(text, "think")), F.lit("")) != "", 1.0).otherwise(0.0)


def _answer(turns: Column) -> Column:
    return F.lower(F.trim(F.coalesce(final_turn(turns)["answer"], F.lit(""))))


def time_format(text: Column, turns: Column) -> Column:
    """1 if there are time tags with a matched answer, or none with a not_matched one."""
    tags, a = has_tag(text, "start") & has_tag(text, "end"), _answer(turns)
    return F.when((a == "matched") & tags, 1.0).when((a == "not_matched") & ~tags, 1.0).otherwise(0.0)


def time_iou(text: Column, turns: Column, gt_time: Column) -> Column:
    """The overlap with the true span for a matched answer with tags; 0.5 for a not_matched one without; 0 for a wrong answer."""
    t, a = final_turn(turns), _answer(turns)
    tags = has_tag(text, "start") & has_tag(text, "end")
    wrong = (t["correct_accept"].isNotNull() | t["correct_reject"].isNotNull()) & ~F.coalesce(t["correct_accept"], F.lit(False)) & ~F.coalesce(t["correct_reject"], F.lit(False))
    said, true = times_last(text), span(gt_time)
    overlap = iou_strict(true["start"], true["end"], said["start"], said["end"])
    return F.when(t.isNull() | wrong, 0.0).when(a == "not_matched", F.when(tags, 0.0).otherwise(0.5)).when((a == "matched") & tags, overlap).otherwise(0.0)


def refine_quality(has_refine: Column, quality: Column, without: float = 0.0) -> Column:
    return F.when(F.coalesce(has_refine, F.lit(False)), F.coalesce(quality, F.lit(0.0))).otherwise(without)


def refine_presence(turns: Column, has_refine: Column) -> Column:
    """1 if the final turn has a refine token; where it doesn't say, if the sample has one."""
    return F.coalesce(final_turn(turns)["has_refine_token"], has_refine, F.lit(False)).cast("double")


#: Name of a reward and its function.
REGISTRY: dict[str, Callable[..., Column]] = {"r_answer_binary": answer_binary, "r_think_format": think_format, "r_time_format": time_format, "r_time_iou": time_iou, "r_refine_presence": refine_presence, "r_query_refine_quality": refine_quality}


def weighted(rewards: list[Column], weights: list[float]) -> Column:
    """Weighted sum; null and NaN rewards count as 0."""
    out = F.lit(0.0)
    for r, w in zip(rewards, weights, strict=True):
        out = out + F.nanvl(F.coalesce(r.cast("double"), F.lit(0.0)), F.lit(0.0)) * w
    return out


def advantages(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Adds `advantage`: the reward less its group's mean, divided by the group's sample deviation plus 1e-4. Groups of one are an error of the caller; their advantage is null."""
    w = Window.partitionBy(group)
    r = F.col(reward)
    return df.withColumn("advantage", (r - F.avg(r).over(w)) / (F.stddev_samp(r).over(w) + 1e-4))


def batch_stats(df: DataFrame, value: str, digits: int = 6) -> DataFrame:
    """One row: n, mean, std, min, max, abs_mean, zero_share (below 1e-9 in size)."""
    x = F.col(value)
    return df.agg(F.count(x).alias("n"), F.round(F.avg(x), digits).alias("mean"), F.round(F.stddev_samp(x), digits).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.round(F.avg(F.abs(x)), digits).alias("abs_mean"), F.round(F.avg((F.abs(x) < 1e-9).cast("double")), digits).alias("zero_share"))


def range_without_nan(value: Column) -> list[Column]:
    """Aggregates min and max of what isn't NaN; NaN if nothing is left."""
    x = F.when(~F.isnan(value), value)
    nan = F.lit(float("nan"))
    return [F.coalesce(F.min(x), nan).alias("min"), F.coalesce(F.max(x), nan).alias("max")]


def above_quantile(df: DataFrame, value: str, mask: str, q: float) -> DataFrame:
    """Adds `kept`: whether an unmasked value reaches the exact, interpolated quantile q of all unmasked ones (found at once, in bounded memory)."""
    cut = exact(df.where(F.col(mask)), F.col(value), q)
    return df.withColumn("kept", F.coalesce(F.col(mask) & (F.col(value) >= F.lit(cut)), F.lit(False)) if cut is not None else F.lit(False))
