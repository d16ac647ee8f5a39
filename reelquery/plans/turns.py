"""Multi-turn analytics, reports and rewards over turns derived from `conversations` by arithmetic on (conv_id, turn)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.operators import report, rewards, turns
from reelquery.plans.registry import Tables, query

#: One derivation for both engines.
_COLUMNS = {
    "idx": "conv_id",
    "pos": "turn",
    "rank": "1 + (conv_id * 7 + turn * 3) % 12",
    "policy_rank": "CASE WHEN (conv_id + turn) % 4 = 0 THEN NULL WHEN (conv_id + turn) % 4 = 1 THEN 0 ELSE 1 + (conv_id * 5 + turn * 2) % 9 END",
    "refine_applied": "(conv_id + turn) % 3 = 0",
    "final_rank": "1 + conv_id % 15",
    "answer": "CASE (conv_id * 3 + turn) % 4 WHEN 0 THEN 'matched' WHEN 1 THEN 'not_matched' WHEN 2 THEN 'Matched ' ELSE 'unknown' END",
    "time_parse_ok": "(conv_id + 2 * turn) % 5 <> 0",
    "iou_raw": "CAST((conv_id * 13 + turn * 7) % 101 AS DOUBLE) / 100",
    "iou_r1": "CASE WHEN (conv_id + turn) % 6 = 0 THEN NULL ELSE CAST((conv_id * 13 + turn * 7) % 101 AS DOUBLE) / 100 END",
    "truth": "CASE WHEN conv_id % 7 = 0 THEN NULL ELSE (conv_id + turn) % 2 = 0 END",
    "shadow": "(conv_id * 2 + turn) % 5 = 0 OR conv_id % 11 = 0",
    "correct_accept": "(conv_id + turn) % 3 = 1",
    "correct_reject": "(conv_id + turn) % 3 = 2 AND turn % 2 = 0",
    "search_ok": "(conv_id + turn) % 2 = 0",
    "answer_ok": "(conv_id * turn) % 3 <> 1",
    "instruction_ok": "(conv_id + turn) % 5 < 3",
}
_T = "t AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _COLUMNS.items()) + " FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"
_POLICY = (
    "WITH "
    + _T
    + """, l AS (SELECT *, lead(rank) OVER (PARTITION BY idx ORDER BY pos) AS nxt FROM t),
p0 AS (SELECT *, CASE WHEN policy_rank > 0 THEN policy_rank WHEN refine_applied AND nxt > 0 THEN nxt WHEN refine_applied AND final_rank > 0 THEN final_rank WHEN rank > 0 THEN rank END AS policy FROM l),
p AS (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY idx ORDER BY pos) AS pos FROM p0 WHERE policy IS NOT NULL)"""
)
_MOST = 8
_METRICS = """round(avg((policy <= 1)::INT), 6) AS r_at_1, round(avg((policy <= 5)::INT), 6) AS r_at_5, round(avg((policy <= 10)::INT), 6) AS r_at_10, round(avg(1 / policy), 6) AS mrr,
count(*) AS n, round(avg(coalesce(iou_r1, 0)), 6) AS miou, round(avg((coalesce(iou_r1, 0) >= 0.3::DOUBLE)::INT), 6) AS iou_30, round(avg((coalesce(iou_r1, 0) >= 0.5::DOUBLE)::INT), 6) AS iou_50, round(avg((coalesce(iou_r1, 0) >= 0.7::DOUBLE)::INT), 6) AS iou_70,
round(coalesce(avg(iou_raw) FILTER (answer = 'matched' AND time_parse_ok), 0), 6) AS miou_matched"""


def _turns(t: Tables) -> DataFrame:
    return t.conversations.where("conv_id is not null and turn is not null").selectExpr(*[f"{e} AS {n}" for n, e in _COLUMNS.items()])


def _policy(t: Tables) -> DataFrame:
    return turns.policy_rank(_turns(t))


@query(_POLICY + " SELECT idx, pos, policy FROM p")
def policy_ranks(t: Tables) -> DataFrame:
    return _policy(t).select("idx", "pos", "policy")


@query(_POLICY + f", c AS (SELECT k AS turn, x.* FROM range(1, {_MOST + 1}) r(k), p x WHERE x.pos = (SELECT max(y.pos) FROM p y WHERE y.idx = x.idx AND y.pos <= k)) SELECT turn, {_METRICS} FROM c GROUP BY 1")
def turn_series_policy(t: Tables) -> DataFrame:
    return turns.series(turns.carried_forward(_policy(t), _MOST))


@query(_POLICY + f" SELECT pos AS turn, {_METRICS} FROM p GROUP BY 1")
def turn_series_strict(t: Tables) -> DataFrame:
    return turns.series(_policy(t).withColumn("turn", F.col("pos")))


@query(_POLICY + """ SELECT pos AS turn, count(*) AS applied, count(*) FILTER (rank > policy) AS improved, count(*) FILTER (rank = policy) AS same, count(*) FILTER (rank < policy) AS worse, count(*) FILTER (policy = 1) AS top1_after,
round(avg(rank - policy) FILTER (rank > policy), 6) AS mean_gain, round(avg(policy - rank) FILTER (rank < policy), 6) AS mean_loss FROM p WHERE refine_applied AND rank > 0 AND policy > 0 GROUP BY 1""")
def refine_effect(t: Tables) -> DataFrame:
    return turns.refine_effect(_policy(t).withColumn("turn", F.col("pos")))


@query(_POLICY + """, d AS (SELECT pos AS turn, CASE WHEN rank > policy THEN 'better' ELSE 'worse' END AS direction, abs(rank - policy) AS d FROM p WHERE refine_applied AND rank > 0 AND policy > 0 AND rank <> policy)
SELECT turn, direction, CASE WHEN d <= 2 THEN d::VARCHAR WHEN d <= 5 THEN '3-5' WHEN d <= 10 THEN '6-10' WHEN d <= 20 THEN '11-20' WHEN d <= 50 THEN '21-50' WHEN d <= 100 THEN '51-100' ELSE '101+' END AS bucket, count(*) AS n FROM d GROUP BY ALL""")
def refine_histogram(t: Tables) -> DataFrame:
    return turns.step_histogram(_policy(t).withColumn("turn", F.col("pos")))


@query("WITH " + _T + """, v AS (SELECT lower(trim(answer)) = 'matched' AS m, truth AS t FROM t WHERE lower(trim(answer)) IN ('matched', 'not_matched') AND truth IS NOT NULL)
SELECT count(*) AS n, round(count(*) FILTER (m = t) / count(*), 6) AS accuracy, count(*) FILTER (m) AS pred_matched, count(*) FILTER (NOT m) AS pred_not_matched, round(count(*) FILTER (m AND t) / count(*) FILTER (m), 6) AS matched_right, round(count(*) FILTER (NOT m AND NOT t) / count(*) FILTER (NOT m), 6) AS not_matched_right FROM v""")
def answer_accuracy(t: Tables) -> DataFrame:
    return turns.answer_accuracy(_turns(t), "answer", "truth")


@query("WITH " + _T + ", f AS (SELECT 'answer' AS field, trim(answer) AS value FROM t UNION ALL SELECT 'rank', rank::VARCHAR FROM t UNION ALL SELECT 'truth', coalesce(truth::VARCHAR, 'unknown') FROM t) SELECT field, value, count(*) AS n FROM f GROUP BY ALL")
def category_counts(t: Tables) -> DataFrame:
    return report.categories(_turns(t), ["answer", "rank", "truth"])


@query("WITH " + _T + """, x AS (SELECT *, (conv + 0) FROM (SELECT *, idx AS conv FROM t))
SELECT CASE WHEN answer = 'matched' THEN 'matched' WHEN refine_applied AND truth AND pos < 3 THEN 'continue_refine' WHEN refine_applied AND truth THEN 'max_turn_reached_with_refine' WHEN refine_applied THEN 'refine_token_no_update' WHEN answer = 'not_matched' THEN 'not_matched_no_refine_token' ELSE 'unknown_no_refine_token' END AS reason, count(*) AS n FROM x GROUP BY 1""")
def stop_reasons(t: Tables) -> DataFrame:
    reason = turns.stop_reason(F.col("answer"), F.col("refine_applied"), F.coalesce("truth", F.lit(False)), F.col("pos"), 3)
    return _turns(t).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + _T + """, r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY pos DESC) AS back, row_number() OVER (PARTITION BY idx ORDER BY pos) AS ahead FROM t WHERE NOT shadow),
g AS (SELECT idx, count(*) AS n, bool_or(correct_accept) FILTER (back = 1) AS acc, count(*) FILTER (back > 1 AND (correct_accept OR correct_reject)) AS hits, bool_or(search_ok) FILTER (ahead = 1) AS srch, count(*) FILTER (answer_ok) AS ans, count(*) FILTER (answer = 'not_matched') AS asked, count(*) FILTER (answer = 'not_matched' AND instruction_ok) AS told FROM r GROUP BY 1)
SELECT i.idx, coalesce(acc, false) AS final_correct, round(CASE WHEN n > 1 THEN hits / (n - 1) ELSE 0 END, 6) AS middle_correct_rate, CASE WHEN n > 0 THEN -(n - 1)::DOUBLE ELSE 0 END AS turn_penalty, CASE WHEN srch THEN 1.0::DOUBLE ELSE 0 END AS format_search, round(coalesce(ans / n, 0), 6) AS format_answer, round(CASE WHEN n IS NULL THEN 0 WHEN asked > 0 THEN told / asked ELSE 1 END, 6) AS format_instruction
FROM (SELECT DISTINCT idx FROM t) i LEFT JOIN g ON i.idx = g.idx""")
def conversation_summary(t: Tables) -> DataFrame:
    return turns.conversation_summary(_turns(t), "idx", "pos")


@query(_POLICY + ", c AS (SELECT pos AS turn, avg((policy <= 1)::INT) AS r1, avg(1 / policy) AS mrr FROM p WHERE pos <= 6 GROUP BY 1) SELECT round(arg_max(round(r1, 6), turn) - arg_min(round(r1, 6), turn), 6) AS delta_r_at_1, round(arg_max(round(mrr, 6), turn) - arg_min(round(mrr, 6), turn), 6) AS delta_mrr FROM c")
def final_deltas(t: Tables) -> DataFrame:
    return report.deltas(turns.series(_policy(t).where("pos <= 6").withColumn("turn", F.col("pos"))), "turn", ["r_at_1", "mrr"])


@query("WITH " + _T + ", g AS (SELECT idx, count(*) AS n FROM t GROUP BY 1) SELECT count(*) AS rows, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM g")
def list_length_stats(t: Tables) -> DataFrame:
    return report.length_stats(_turns(t).groupBy("idx").agg(F.collect_list("pos").alias("l")), "l")


_REWARD = "WITH " + _T + ", r AS (SELECT *, idx * 100 + pos AS id, CASE WHEN (idx + pos) % 8 = 0 THEN 'NaN'::DOUBLE WHEN (idx + pos) % 9 = 0 THEN NULL ELSE iou_raw END AS a, CAST((idx + pos) % 3 AS DOUBLE) - 1 AS b FROM t), s AS (SELECT *, 0.5::DOUBLE * CASE WHEN a IS NULL OR isnan(a) THEN 0 ELSE a END + 2.0::DOUBLE * b AS w FROM r)"


def _rewards(t: Tables) -> DataFrame:
    rows = _turns(t).withColumn("id", F.expr("idx * 100 + pos"))
    a = F.when((F.col("idx") + F.col("pos")) % 8 == 0, F.lit(float("nan"))).when((F.col("idx") + F.col("pos")) % 9 == 0, F.lit(None).cast("double")).otherwise(F.col("iou_raw"))
    rows = rows.withColumn("a", a).withColumn("b", ((F.col("idx") + F.col("pos")) % 3).cast("double") - 1)
    return rows.withColumn("w", rewards.weighted([F.col("a"), F.col("b")], [0.5, 2.0]))


@query(_REWARD + " SELECT id, round(w, 6) AS reward, round((w - avg(w) OVER (PARTITION BY idx)) / (stddev_samp(w) OVER (PARTITION BY idx) + 1e-4), 6) AS advantage FROM s")
def advantages(t: Tables) -> DataFrame:
    return rewards.advantages(_rewards(t), "idx", "w").select("id", F.round("w", 6).alias("reward"), F.round("advantage", 6).alias("advantage"))


@query(_REWARD + " SELECT count(w) AS n, round(avg(w), 6) AS mean, round(stddev_samp(w), 6) AS std, min(w) AS min, max(w) AS max, round(avg(abs(w)), 6) AS abs_mean, round(avg((abs(w) < 1e-9)::INT), 6) AS zero_share FROM s")
def batch_stats(t: Tables) -> DataFrame:
    return rewards.batch_stats(_rewards(t), "w")


@query(_REWARD + " SELECT idx, coalesce(min(a) FILTER (NOT isnan(a)), 'NaN'::DOUBLE) AS min, coalesce(max(a) FILTER (NOT isnan(a)), 'NaN'::DOUBLE) AS max FROM r GROUP BY 1")
def nan_free_range(t: Tables) -> DataFrame:
    return _rewards(t).groupBy("idx").agg(*rewards.range_without_nan(F.col("a")))


@query(_REWARD + ", c AS (SELECT quantile_cont(iou_raw, 0.8) AS c FROM r WHERE refine_applied) SELECT id, coalesce(refine_applied AND iou_raw >= c, false) AS kept FROM r, c")
def quantile_mask(t: Tables) -> DataFrame:
    return rewards.above_quantile(_rewards(t), "iou_raw", "refine_applied", 0.8).select("id", "kept")


_ROLLOUT = """WITH t AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'matched' WHEN 1 THEN 'not_matched' WHEN 2 THEN 'Matched' WHEN 3 THEN 'unknown' END AS answer, 'v' || (event_id % 3) AS retrieved, 'v' || (event_id % 2) AS solution,
CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 4 = 1 END AS accept, CAST(event_id % 50 AS DOUBLE) AS gs, CAST(event_id % 50 + event_id % 7 AS DOUBLE) AS ge, CAST(event_id % 47 AS DOUBLE) AS ps, CAST(event_id % 47 + event_id % 9 - 2 AS DOUBLE) AS pe, event_id % 6 AS form FROM events),
x AS (SELECT *, lower(trim(coalesce(answer, ''))) AS a, form < 4 AS tags,
CASE WHEN ge > gs AND pe > ps THEN greatest(0, least(1, greatest(0, least(ge, pe) - greatest(gs, ps)) / (greatest(ge, pe) - least(gs, ps)))) ELSE 0 END AS iou FROM t)
"""


def _rollouts(t: Tables) -> DataFrame:
    e = t.events.selectExpr(
        "event_id AS id",
        "CASE event_id % 5 WHEN 0 THEN 'matched' WHEN 1 THEN 'not_matched' WHEN 2 THEN 'Matched' WHEN 3 THEN 'unknown' END AS answer",
        "concat('v', event_id % 3) AS retrieved",
        "concat('v', event_id % 2) AS solution",
        "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 4 = 1 END AS accept",
        "event_id % 50 AS gs",
        "event_id % 50 + event_id % 7 AS ge",
        "event_id % 47 AS ps",
        "event_id % 47 + event_id % 9 - 2 AS pe",
        "event_id % 6 AS form",
    )
    turn = lambda shadow: F.struct(F.lit(shadow).alias("shadow"), F.col("answer"), F.col("retrieved").alias("retrieved_id"), F.col("accept").alias("correct_accept"), F.when(F.col("accept").isNotNull(), F.lit(False)).alias("correct_reject"), F.when(F.col("id") % 3 > 0, F.col("id") % 3 == 1).alias("has_refine_token"))
    text = F.when(F.col("form") < 4, F.concat(F.when(F.col("id") % 2 == 0, "<think> so </think>").otherwise("<think> </think>"), F.lit("<answer>x</answer><start> "), F.col("ps").cast("string"), F.lit("</start> <END>"), F.col("pe").cast("string"), F.lit(" </END>"))).otherwise("no tags")
    return e.select("id", F.array(turn(False), turn(True)).alias("turns"), "solution", text.alias("text"), F.array(F.col("gs").cast("double"), F.col("ge").cast("double")).alias("gt_time"), (F.col("id") % 4 == 3).alias("has_refine"))


@query(_ROLLOUT + """SELECT id, CASE WHEN coalesce(answer, '') = CASE WHEN retrieved = solution THEN 'matched' ELSE 'not_matched' END THEN 1.0::DOUBLE ELSE -1 END AS answer_binary,
CASE WHEN tags AND id % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END AS think, CASE WHEN a = 'matched' AND tags OR a = 'not_matched' AND NOT tags THEN 1.0::DOUBLE ELSE 0 END AS time_format,
round(CASE WHEN accept IS NOT NULL AND NOT accept THEN 0 WHEN a = 'not_matched' THEN CASE WHEN tags THEN 0 ELSE 0.5::DOUBLE END WHEN a = 'matched' AND tags THEN iou ELSE 0 END, 6) AS time_iou,
CASE WHEN id % 3 > 0 THEN (id % 3 = 1)::INT::DOUBLE ELSE (id % 4 = 3)::INT::DOUBLE END AS presence, CASE WHEN id % 4 = 3 THEN ge ELSE -1.0::DOUBLE END AS quality FROM x""")
def rollout_rewards(t: Tables) -> DataFrame:
    r, text, turns_ = _rollouts(t), F.col("text"), F.col("turns")
    fs = rewards.REGISTRY
    return r.select(
        "id",
        fs["r_answer_binary"](turns_, F.col("solution")).alias("answer_binary"),
        fs["r_think_format"](text).alias("think"),
        fs["r_time_format"](text, turns_).alias("time_format"),
        F.round(fs["r_time_iou"](text, turns_, F.col("gt_time")), 6).alias("time_iou"),
        fs["r_refine_presence"](turns_, F.col("has_refine")).alias("presence"),
        fs["r_query_refine_quality"](F.col("has_refine"), F.element_at("gt_time", 2), -1.0).alias("quality"),
    )


@query("""WITH l AS (SELECT event_id AS step, CASE WHEN event_id % 3 = 0 THEN value END AS loss, CASE WHEN event_id % 5 = 0 THEN value * 2 END AS reward FROM events),
f AS (SELECT loss, last_value(reward IGNORE NULLS) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reward FROM l) SELECT round(avg(loss), 6) AS loss, round(avg(reward), 6) AS reward FROM f""")
def log_averages(t: Tables) -> DataFrame:
    rows = t.events.selectExpr("event_id AS step", "CASE WHEN event_id % 3 = 0 THEN value END AS loss", "CASE WHEN event_id % 5 = 0 THEN value * 2 END AS reward")
    return report.log_averages(rows, "step", ["loss", "reward"], ["reward"])


@query("""WITH c AS (SELECT user_id AS label, min(event_id) AS ord, CASE WHEN user_id % 5 = 0 THEN 0 ELSE round(avg(value), 1) END AS a, round(max(value), 0) AS b, CASE WHEN user_id % 3 = 0 THEN 0 ELSE count(*)::DOUBLE END AS c FROM events GROUP BY 1)
SELECT row_number() OVER (ORDER BY a DESC, b DESC, c DESC, ord) AS place, label, a AS iou_50, b AS miou, c AS r_at_1 FROM c""")
def leaderboard(t: Tables) -> DataFrame:
    events = t.events.select(F.col("user_id").alias("label"), "event_id", "value", F.struct("_metadata.file_name", "_metadata.row_index").alias("at"))
    rows = report.means_in_order(events, "label", "at", "value", F.min("event_id").alias("ord"), F.round(F.max("value"), 0).alias("b"), F.count(F.lit(1)).cast("double").alias("c"))
    every = lambda n: F.coalesce(F.col("label") % n == 0, F.lit(False))
    nested = rows.select("label", "ord", F.struct(F.when(~every(5), report.rounded(F.col("mean"), 1)).alias("iou_50"), F.col("b").alias("miou")).alias("temporal"), F.struct(F.when(~every(3), F.col("c")).alias("r_at_1")).alias("retrieval"))
    return report.leaderboard(nested, {"iou_50": F.col("temporal.iou_50"), "miou": F.col("temporal.miou"), "r_at_1": F.col("retrieval.r_at_1")}, ["iou_50", "miou", "r_at_1"], "label", "ord")
