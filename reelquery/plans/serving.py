"""Retries, progress and refreshed negatives over `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.operators import serving
from reelquery.operators.order import numbered
from reelquery.plans.registry import Tables, query


@query("""
WITH u AS (SELECT *, event_id % 4 = 0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events QUALIFY k <= 3)
SELECT user_id, coalesce(arg_min('c' || event_id, k) FILTER (ok), '') AS content, CASE WHEN count(*) FILTER (ok) = 0 THEN arg_max('http_' || (500 + event_id % 7), k) END AS error,
  coalesce(min(k) FILTER (ok), max(k)) AS tries FROM u GROUP BY 1""")
def bounded_retry(t: Tables) -> DataFrame:
    """Attempts of a user, of which every fourth succeeds, with two retries."""
    e = t.events
    attempts = e.select("user_id", "event_id", (e.event_id % 4 == 0).alias("ok"), F.concat(F.lit("c"), "event_id").alias("content"), F.concat(F.lit("http_"), 500 + e.event_id % 7).alias("error"))
    return serving.with_retries(attempts, "user_id", "event_id", 2)


@query("""
WITH n AS (SELECT row_number() OVER (ORDER BY event_id) AS done, (event_id % 5 + row_number() OVER (ORDER BY event_id))::DOUBLE AS elapsed, count(*) OVER () AS total FROM events)
SELECT done, round(100.0::DOUBLE * done / total, 1) AS percent, round(done / elapsed, 6) AS rate, round((total - done) / (done / elapsed), 6) AS eta FROM n WHERE done % 250 = 0 OR done = total""")
def run_progress(t: Tables) -> DataFrame:
    """How far a run is, each 250 rows and at the end."""
    total = F.lit(t.events.count())
    rows = numbered(t.events.select("event_id"), ["event_id"], "at").withColumn("done", F.col("at") + 1)
    said = rows.where(serving.reported(F.col("done"), total, 250))
    return said.select("done", serving.progress(F.col("done"), total, (F.col("done") + F.col("event_id") % 5).cast("double")).alias("p")).select("done", "p.*")


@query("""
WITH m AS (SELECT user_id AS qid, event_id % 10 * 100 AS point, max(event_id) AS neg FROM events GROUP BY 1, 2)
SELECT event_id, user_id AS qid, event_id % 1000 AS step, event_id % 1000 // 100 * 100 AS point, neg, event_id % 1000 > 0 AND event_id % 100 = 0 AND event_id % 1000 <> 200 AS due
FROM events LEFT JOIN m ON m.qid = user_id AND m.point = event_id % 1000 // 100 * 100""")
def refreshed_negatives(t: Tables) -> DataFrame:
    """Negatives mined anew each hundred steps, and the steps at which that is due if step 200 was the last."""
    e = t.events
    mined = e.groupBy(F.col("user_id").alias("qid"), (e.event_id % 10 * 100).alias("point")).agg(F.max("event_id").alias("neg"))
    steps = e.select("event_id", F.col("user_id").alias("qid"), (e.event_id % 1000).alias("step"))
    return serving.refreshed(steps, mined, 100).withColumn("due", serving.refresh_due(F.col("step"), F.lit(200), 100))
