"""Multi-turn analytics over one row per executed turn.

Turns come as rows (idx, pos, rank, policy_rank, refine_applied, final_rank, answer, time_parse_ok, iou_raw, iou_r1),
pos counting from 1; `long_form` makes them of an array column. Policy series carry the last turn forward to the
largest turn number; strict series hold executed turns only. Their denominators differ on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelquery.functions.parse import rank_step_bucket


def long_form(df: DataFrame, key: str, turns: str, carry: list[str] = ()) -> DataFrame:
    """One row for each element of the array column: key, carried columns, pos (from 1) and the element's fields."""
    return df.select(key, *carry, F.posexplode(turns).alias("__p", "__t")).select(key, *carry, (F.col("__p") + 1).alias("pos"), "__t.*")


def policy_rank(df: DataFrame, key: str = "idx") -> DataFrame:
    """Adds `policy`: the policy rank if it is above 0; else, where a refinement was applied, the next turn's rank or the final rank; else the rank. Turns without any are left out and pos is counted anew."""
    w = Window.partitionBy(key).orderBy("pos")
    above = lambda c: F.when(c > 0, c)
    after = F.when(F.col("refine_applied"), F.coalesce(above(F.lead("rank").over(w)), above(F.col("final_rank"))))
    out = df.withColumn("policy", F.coalesce(above(F.col("policy_rank")), after, above(F.col("rank")))).where("policy is not null")
    return out.withColumn("pos", F.row_number().over(w))


def carried_forward(df: DataFrame, max_turn: int, key: str = "idx") -> DataFrame:
    """A row for each turn from 1 to max_turn: the turn itself, or the last one before it."""
    w = Window.partitionBy(key).orderBy("pos")
    until = F.coalesce(F.lead("pos").over(w) - 1, F.lit(max_turn))
    return df.withColumn("__until", until).where(F.col("__until") >= F.col("pos")).withColumn("turn", F.explode(F.sequence(F.col("pos"), F.col("__until")))).drop("__until").where(F.col("turn") <= max_turn)


def temporal(iou: Column, matched_raw: Column | None = None, digits: int = 6) -> list[Column]:
    """Aggregates over all rows, missing overlaps as 0: n, miou, iou_30, iou_50, iou_70, and the mean over matched rows only."""
    v = F.when(F.isnan(iou) | (iou < 0), 0.0).otherwise(F.coalesce(iou, F.lit(0.0)))
    out = [F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg(v), F.lit(0.0)), digits).alias("miou")]
    out += [F.round(F.coalesce(F.avg((v >= t).cast("double")), F.lit(0.0)), digits).alias(f"iou_{int(t * 100)}") for t in (0.3, 0.5, 0.7)]
    if matched_raw is not None:
        out.append(F.round(F.coalesce(F.avg(matched_raw), F.lit(0.0)), digits).alias("miou_matched"))
    return out


def series(df: DataFrame, digits: int = 6) -> DataFrame:
    """turn, n, r_at_1, r_at_5, r_at_10, mrr, miou, iou_30, iou_50, iou_70, miou_matched of rows with turn, policy, iou_r1, iou_raw, answer, time_parse_ok."""
    r = F.col("policy")
    matched = F.when((F.col("answer") == "matched") & F.col("time_parse_ok"), F.col("iou_raw"))
    ranks = [F.round(F.avg((r <= k).cast("double")), digits).alias(f"r_at_{k}") for k in (1, 5, 10)]
    return df.groupBy("turn").agg(*ranks, F.round(F.avg(1 / r), digits).alias("mrr"), *temporal(F.col("iou_r1"), matched, digits))


def refine_effect(df: DataFrame, digits: int = 6) -> DataFrame:
    """By turn, of turns with a refinement applied and both ranks known: applied, improved, same, worse, top1_after, mean_gain, mean_loss."""
    step = F.col("rank") - F.col("policy")
    some = df.where("refine_applied and rank > 0 and policy > 0")
    return some.groupBy("turn").agg(
        F.count(F.lit(1)).alias("applied"),
        F.count_if(step > 0).alias("improved"),
        F.count_if(step == 0).alias("same"),
        F.count_if(step < 0).alias("worse"),
        F.count_if(F.col("policy") == 1).alias("top1_after"),
        F.round(F.avg(F.when(step > 0, step)), digits).alias("mean_gain"),
        F.round(F.avg(F.when(step < 0, -step)), digits).alias("mean_loss"),
    )


def step_histogram(df: DataFrame) -> DataFrame:
    """turn, direction, bucket, n of rank changes by refinement."""
    step = F.col("rank") - F.col("policy")
    some = df.where("refine_applied and rank > 0 and policy > 0 and rank <> policy")
    return some.groupBy("turn", F.when(step > 0, "better").otherwise("worse").alias("direction"), rank_step_bucket(F.abs(step)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def answer_accuracy(df: DataFrame, answer: str, truth: str, digits: int = 6) -> DataFrame:
    """Over rows with a known answer and truth: n, accuracy, pred_matched, pred_not_matched, and the share right among each; shares of nothing are 0."""
    a = F.lower(F.trim(F.col(answer)))
    t = F.col(truth)
    some = df.where(a.isin("matched", "not_matched") & t.isNotNull()).select((a == "matched").alias("m"), t.alias("t"))
    share = lambda x, y: F.round(F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0)), digits)
    out = some.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m") == F.col("t")).alias("right"), F.count_if("m").alias("pred_matched"), F.count_if(~F.col("m")).alias("pred_not_matched"), F.count_if(F.col("m") & F.col("t")).alias("rm"), F.count_if(~F.col("m") & ~F.col("t")).alias("rn"))
    return out.select("n", share(F.col("right"), F.col("n")).alias("accuracy"), "pred_matched", "pred_not_matched", share(F.col("rm"), F.col("pred_matched")).alias("matched_right"), share(F.col("rn"), F.col("pred_not_matched")).alias("not_matched_right"))


def stop_reason(answer: Column, has_token: Column, updated: Column, turn: Column, max_turn: int) -> Column:
    """Why a multi-turn search goes on or ends."""
    return (
        F.when(answer == "matched", "matched")
        .when(has_token & updated & (turn < max_turn), "continue_refine")
        .when(has_token & updated, "max_turn_reached_with_refine")
        .when(has_token, "refine_token_no_update")
        .when(answer == "not_matched", "not_matched_no_refine_token")
        .otherwise("unknown_no_refine_token")
    )


def search_turns(df: DataFrame, max_turns: int) -> DataFrame:
    """The rows that `streaming.machine.search` emits, from a table of all turns (idx, turn, query, answer, instruction, retrieved, truth).

    A turn is worked off if all turns before it are there, none of them was answered `matched`, and it isn't beyond
    max_turns; of turns with one number any counts.
    """
    w = Window.partitionBy("idx").orderBy("turn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    one = df.where(F.col("idx").isNotNull() & F.col("turn").between(1, max_turns)).dropDuplicates(["idx", "turn"])
    matched, refused = F.col("answer").eqNullSafe(F.lit("matched")), F.col("answer").eqNullSafe(F.lit("not_matched"))
    right = F.coalesce(F.col("retrieved") == F.col("truth"), F.lit(False))
    told = F.coalesce(F.col("instruction"), F.lit("")) != ""
    base = F.coalesce(F.first("query").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(""))
    state = F.when(matched, "matched").when(F.col("turn") >= max_turns, "max_turn").otherwise("active")
    following = F.when(state == "active", F.when(told, F.concat(base, F.lit("\n"), F.col("instruction"))).otherwise(base))
    out = one.withColumns({"__n": F.row_number().over(w), "__ended": F.coalesce(F.max(matched).over(before), F.lit(False)), "state": state, "next_query": following})
    out = out.withColumn("search_query", F.coalesce(F.lag("next_query").over(w), base)).where("__n = turn and not __ended")
    return out.select("idx", "turn", "search_query", "answer", (matched | refused).alias("answer_ok"), (refused & told).alias("instruction_ok"), (right & matched).alias("correct_accept"), (~right & refused).alias("correct_reject"), "state", "next_query")


def conversation_summary(df: DataFrame, key: str, pos: str, digits: int = 6) -> DataFrame:
    """Per conversation over its non-shadow turns: final_correct, middle_correct_rate, turn_penalty, format_search, format_answer, format_instruction; a conversation of shadow turns only gets zeros."""
    real = ~F.col("shadow")
    last = F.max(F.when(real, F.col(pos)))
    n = F.count_if(real)
    hit = F.col("correct_accept") | F.col("correct_reject")
    no = real & (F.col("answer") == "not_matched")
    agg = df.groupBy(key).agg(
        n.alias("n"),
        F.max_by(F.when(real, F.col("correct_accept")), F.when(real, F.col(pos))).alias("accept"),
        F.max_by(F.when(real, hit.cast("int")), F.when(real, F.col(pos))).alias("last_hit"),
        F.sum(F.when(real, hit.cast("int"))).alias("hits"),
        F.min_by(F.when(real, F.col("search_ok")), F.when(real, F.col(pos))).alias("first_search"),
        F.sum(F.when(real, F.col("answer_ok").cast("int"))).alias("answers"),
        F.count_if(no).alias("asked"),
        F.sum(F.when(no, F.col("instruction_ok").cast("int"))).alias("told"),
        last.alias("last"),
    )
    some = F.col("n") > 0
    return agg.select(
        key,
        F.coalesce(F.col("accept"), F.lit(False)).alias("final_correct"),
        F.round(F.when(F.col("n") > 1, (F.col("hits") - F.col("last_hit")) / (F.col("n") - 1)).otherwise(0.0), digits).alias("middle_correct_rate"),
        F.when(some, -(F.col("n") - 1).cast("double")).otherwise(0.0).alias("turn_penalty"),
        F.when(some & F.col("first_search"), 1.0).otherwise(0.0).alias("format_search"),
        F.round(F.when(some, F.col("answers") / F.col("n")).otherwise(0.0), digits).alias("format_answer"),
        F.round(F.when(~some, 0.0).when(F.col("asked") > 0, F.col("told") / F.col("asked")).otherwise(1.0), digits).alias("format_instruction"),
    )


def final_turn(turns: Column) -> Column:
    """The last turn of an array that isn't a shadow, else the last one."""
    return F.coalesce(F.try_element_at(F.filter(turns, lambda t: ~F.coalesce(t["shadow"], F.lit(False))), F.lit(-1)), F.try_element_at(turns, F.lit(-1)))
