"""Findings of round 4: what these tests hold was wrong before."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelquery.operators import grid, report, retrieval
from reelquery.plans import QUERIES
from tests.test_findings_r03 import against_sql, rows_of


def test_leaderboard_means_are_plain_sums(spark, tmp_path):
    """Means near a half go the way that doubles added up in the table's order take them, as in the SQL; a null user is a user."""
    value = "CASE WHEN i % 7 = 0 THEN NULL ELSE (hash(i * 31) % 9000)::DOUBLE / 100 + CASE WHEN i % 2 = 0 THEN 0.05 ELSE 0 END END"
    for n, order in enumerate(("i", "i % 10, i")):
        (tmp_path / str(n)).mkdir()
        events = f"SELECT i::BIGINT AS event_id, nullif(hash(i) % 900, 7)::BIGINT AS user_id, {value} AS value FROM range(9000) r(i) ORDER BY {order}"
        got, want = against_sql(spark, tmp_path / str(n), "leaderboard", events=events)
        assert got == want


def test_rounded(spark):
    x = [51.449999999999996, 54.35, 45.94999999999999, -54.35, 1e308, float("inf"), float("nan"), None]
    got = [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").orderBy("i").select(report.rounded(F.col("v"), 1).alias("y")).collect()]
    assert got[:6] == [51.5, 54.4, 45.9, -54.4, 1e308, float("inf")] and got[6] != got[6] and got[7] is None


def test_rerank_head_shuffles_no_pairs(spark, monkeypatch):
    """The corpus is streamed past blocks of queries, which rank their own pairs; before, all pairs were shuffled and sorted on disk."""
    monkeypatch.setattr(grid, "pairs", None)
    monkeypatch.setattr(retrieval, "scores", None)
    plan = QUERIES["rerank_head"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "CartesianProduct" in line)
    assert "MapInArrow" in plan[at - 1] and "+- Project [qid" in plan[at - 2]
    assert not any("Window" in line for line in plan[at:])


@pytest.mark.parametrize("held", [1 << 24, 4 * 90 * 2, 1])  # one block a core, one or two ids a block, and ids whose pairs are too many for a task
def test_ranks_beyond_the_best(spark, monkeypatch, held):
    """Equal vectors, ids that occur twice on both sides, nulls, small packs."""
    for name, value in {"HELD": held, "PACK_BYTES": 8 * 4 * 5, "PAIR_DOCS": 16, "RANKS": 7}.items():
        monkeypatch.setattr(grid, name, value)
    rng = np.random.default_rng(5)
    base = rng.integers(-3, 4, (12, 4)) / 4 + 0.0005
    rows = [(i % 80, base[rng.integers(12)].tolist()) for i in range(88)]
    for kind in ("float", "double"):
        x = spark.createDataFrame([*rows, (None, rows[0][1]), (500, None)], "doc bigint, dvec array<double>").withColumn("dvec", F.col("dvec").cast(f"array<{kind}>"))
        q = x.where("doc % 8 = 0 or doc is null").select(F.col("doc").alias("qid"), F.col("dvec").alias("qvec"))
        for self_match in (True, False):
            scored = retrieval.scores(q.where("qid is not null and qvec is not null"), x.where("doc is not null and dvec is not null"))
            w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc"))
            want = (scored if self_match else scored.where("doc <> qid")).withColumn("rank", F.row_number().over(w)).where("rank > 3").select("qid", "doc", "rank")
            assert rows_of(grid.beyond(q, x, 3, self_match)) == rows_of(want)
    assert grid.beyond(q.where("false"), x, 3).count() == 0 and grid.beyond(q, x.where("false"), 3).count() == 0
