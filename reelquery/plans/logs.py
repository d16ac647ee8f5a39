"""Queries that write and read: JSON lines, and streams over a folder of log files, in the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.functions import parse
from reelquery.plans.registry import Tables, query
from reelquery.sources import adapters, jsonl, sinks
from reelquery.streaming import logs, machine


def _place(t: Tables, name: str) -> str:
    base = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.sparkContext.getCheckpointDir()
    if not base:
        if not t.spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="reelquery-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events WHERE event_id % 10 > 0")
def jsonl_round_trip(t: Tables) -> DataFrame:
    """Rows written as JSON lines with every tenth line broken, read back without the broken ones."""
    path = _place(t, "jsonl")
    rows = t.events.select("event_id", "event_type", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("value"))
    line = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.col("value"))
    rows.withColumn("value", sinks_line()).select("event_id", "value").select(line.alias("value")).write.text(path)
    return jsonl.read_jsonl(t.spark, path, "event_id bigint, event_type string, value double").drop("ord")


def sinks_line():
    return F.to_json(F.struct("event_id", "event_type", "value"), {"ignoreNullFields": "false"})


@query("SELECT count(*) FILTER (event_id % 10 > 0) AS good, count(*) FILTER (event_id % 10 = 0) AS bad FROM events")
def jsonl_bad_lines(t: Tables) -> DataFrame:
    path = _place(t, "jsonl")
    t.events.select(F.when(F.col("event_id") % 10 == 0, F.lit("[1]")).otherwise(F.to_json(F.struct("event_id")))).toDF("value").write.text(path)
    return jsonl.bad_lines(t.spark, path)


@query("SELECT '[' || event_id || ']' AS line FROM events WHERE event_id % 10 = 0 ORDER BY event_id LIMIT 5")
def jsonl_warnings(t: Tables) -> DataFrame:
    """The first five lines that are no objects, in order of the files."""
    path = _place(t, "jsonl")
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("["), "event_id", F.lit("]"))).otherwise(F.to_json(F.struct("event_id")))
    t.events.repartitionByRange("event_id").sortWithinPartitions("event_id").select(line.alias("value")).write.text(path)
    return jsonl.warnings(t.spark, path).select("line")


@query("SELECT event_id, value FROM events")
def stream_append(t: Tables) -> DataFrame:
    """A folder of JSON lines as a stream, appended to a table, each id once although the log has it twice and the query is started twice."""
    path, out, state = _place(t, "log"), _place(t, "out"), _place(t, "state")
    rows = t.events.select("event_id", "value")
    for _ in range(2):
        sinks.write_jsonl(rows, path, "append")
        logs.append(logs.log_stream(t.spark, path, "event_id bigint, value double"), out, state, key="event_id").awaitTermination()
    return logs.appended(t.spark, out)


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0")
def stream_resume(t: Tables) -> DataFrame:
    """What is left to do after two logs."""
    e = t.events.select("event_id")
    return logs.remaining(e, e.where("event_id % 3 = 0"), e.where("event_id % 5 = 0"), key="event_id")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_upsert(t: Tables) -> DataFrame:
    """Two streams put rows into one table, each batch the last row of a key; it reads back merged."""
    out = _place(t, "out")
    for k in (0, 1):
        path = _place(t, "log")
        sinks.write_jsonl(t.events.where(F.col("event_id") % 2 == k).select("user_id", "event_id"), path)
        logs.upsert_batches(logs.log_stream(t.spark, path, "user_id bigint, event_id bigint"), out, _place(t, "state"), "user_id", "event_id").awaitTermination()
    return logs.appended(t.spark, out)


@query("SELECT 'idx:' || event_id % 300 AS log_key, arg_max(1 + event_id % 17, event_id) AS rank FROM events GROUP BY 1")
def stream_watch(t: Tables) -> DataFrame:
    """The rank that stands for each log key, kept in a table by a stream."""
    return _watched(t)[0]


@query("SELECT count(*) AS n, round(avg(1 / rank), 6) AS mrr, round(avg((rank <= 5)::INT), 6) AS r_at_5 FROM (SELECT event_id % 300 AS k, arg_max(1 + event_id % 17, event_id) AS rank FROM events GROUP BY 1)")
def stream_watch_metrics(t: Tables) -> DataFrame:
    """The metrics that the last batch of that stream reported."""
    report = _watched(t)[1]
    return report.orderBy(F.desc("batch")).limit(1).drop("batch")


def _watched(t: Tables) -> tuple[DataFrame, DataFrame]:
    path, out, report = _place(t, "log"), _place(t, "out"), _place(t, "report")
    rows = t.events.selectExpr("event_id % 300 AS index", "'' AS qid", "1 + event_id % 17 AS rank", "event_id AS at")
    for k in (0, 1):
        sinks.write_jsonl(rows.where(F.col("at") % 2 == k), path, "append")
    stream = logs.keyed(logs.log_stream(t.spark, path, "index bigint, qid string, rank bigint, at bigint", 4))
    metrics = [F.count(F.lit(1)).alias("n"), F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"), F.round(F.avg((F.col("rank") <= 5).cast("int")), 6).alias("r_at_5")]
    logs.watch(stream, out, _place(t, "state"), "log_key", "at", metrics, report).awaitTermination()
    return logs.appended(t.spark, out).select("log_key", "rank"), logs.appended(t.spark, report)


@query("SELECT event_id, value FROM events WHERE event_id % 2 = 1")
def snapshot_replace(t: Tables) -> DataFrame:
    """A table whose rows are replaced as a whole; readers of its first version still find that."""
    path = _place(t, "whole")
    rows = t.events.select("event_id", "value")
    sinks.replace_whole(rows, path)
    sinks.replace_whole(rows.where("event_id % 2 = 1"), path)
    return sinks.read_whole(t.spark, path)


#: Turns of a search from (conv_id, turn), one text for both engines; a conversation is numbered from 0.
_SEARCH = {
    "idx": "conv_id",
    "turn": "turn + 1",
    "query": "concat('query ', conv_id)",
    "response": "concat('<think> hm </think> <answer> ', CASE (conv_id * 3 + turn * 5) % 7 WHEN 0 THEN 'Matched' WHEN 1 THEN 'unclear' ELSE 'not matched' END, ' </answer>', CASE WHEN (conv_id + turn) % 3 > 0 THEN concat('<search_instruction> look at ', turn, ' </search_instruction>') ELSE '' END)",
    "retrieved": "concat('v', (conv_id + turn * 2) % 5)",
    "truth": "concat('v', conv_id % 5)",
    "at_ms": "1704067200000 + conv_id * 1000 + turn * 60000",
}


@query(f"""
WITH t AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _SEARCH.items())} FROM conversations WHERE conv_id IS NOT NULL AND turn < 6),
u AS (SELECT *, CASE (idx * 3 + (turn - 1) * 5) % 7 WHEN 0 THEN 'matched' WHEN 1 THEN 'unknown' ELSE 'not_matched' END AS answer, CASE WHEN (idx + turn - 1) % 3 > 0 THEN 'look at ' || (turn - 1) ELSE '' END AS told, row_number() OVER w AS n, retrieved = truth AS hit FROM t WINDOW w AS (PARTITION BY idx ORDER BY turn)),
v AS (SELECT *, coalesce(bool_or(answer = 'matched') OVER (PARTITION BY idx ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended,
  CASE WHEN answer = 'matched' THEN 'matched' WHEN turn = 6 THEN 'max_turn' ELSE 'active' END AS state FROM u WHERE n = turn),
x AS (SELECT *, CASE WHEN state = 'active' THEN query || CASE WHEN told = '' THEN '' ELSE chr(10) || told END END AS next_query FROM v)
SELECT idx, turn, coalesce(lag(next_query) OVER (PARTITION BY idx ORDER BY turn), query) AS search_query, answer, answer <> 'unknown' AS answer_ok, answer = 'not_matched' AND told <> '' AS instruction_ok,
  hit AND answer = 'matched' AS correct_accept, NOT hit AND answer = 'not_matched' AS correct_reject, state, next_query FROM x WHERE NOT ended""")
def live_search(t: Tables) -> DataFrame:
    """The multi-turn search as a stream of turns that is stopped and started again in mid-search: the log's second half has turns that come before the first half's."""
    path, out, state = _place(t, "log"), _place(t, "out"), _place(t, "state")
    rows = t.conversations.where("conv_id is not null and turn is not null").selectExpr(*[f"{e} AS {n}" for n, e in _SEARCH.items()])
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(provider)
    t.spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in ("(idx + turn) % 2 = 0", "(idx + turn) % 2 = 1"):
            sinks.write_jsonl(rows.where(part), path, "append")
            said = logs.log_stream(t.spark, path, "idx bigint, turn int, query string, response string, retrieved string, truth string, at_ms bigint")
            turns = said.select("idx", "turn", F.timestamp_millis("at_ms").alias("at"), "query", parse.answer_first(F.col("response")).alias("answer"), F.coalesce(parse.last_tag(F.col("response"), "search_instruction"), F.lit("")).alias("instruction"), "retrieved", "truth")
            logs.append(machine.search(turns, max_turns=6, idle="3650 days", late="3650 days"), out, state).awaitTermination()
    finally:
        t.spark.conf.set(provider, before)
    return logs.appended(t.spark, out)


@query("""SELECT item_id::VARCHAR AS problem_id, text AS problem, CASE WHEN item_id % 2 = 0 THEN 'yes' ELSE 'b' END AS solution, 'multiple choice' AS problem_type, 'multiple-choice' AS source FROM benchmark
UNION ALL SELECT item_id::VARCHAR, text, 'v' || item_id, 'verified search', 'Verified-Search-toy' FROM benchmark""")
def adapted_rows(t: Tables) -> DataFrame:
    choice = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.when(F.col("item_id") % 2 == 0, "<answer> yes </answer>").otherwise("so \\boxed{b}").alias("answer"), F.array(F.lit("yes"), F.lit("no")).alias("options"))
    search = t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("query"), F.concat(F.lit("v"), "item_id").alias("gt_video"), F.lit("x.npy").alias("retrieved_video"))
    return adapters.adapted_all({"multiple-choice": choice, "Verified-Search-toy": search}).select("problem_id", "problem", "solution", "problem_type", "source")


@query("SELECT conv_id, count(*) AS n, string_agg(CASE lower(role) WHEN 'user' THEN 'user' WHEN 'human' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'system' THEN 'system' WHEN 'tool' THEN 'tool' ELSE 'user' END, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def share_gpt_rows(t: Tables) -> DataFrame:
    chats = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("r"))
    chats = chats.select("conv_id", F.transform("r", lambda x: F.struct(x["role"].alias("from"), x["text"].alias("value"))).alias("conversations"))
    out = adapters.share_gpt(chats)
    return out.select("conv_id", F.size("messages").cast("bigint").alias("n"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))
