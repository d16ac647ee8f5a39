"""Rules that are easy to get wrong, on hand-made rows."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from reelquery.functions import parse, sampling, temporal, vector
from reelquery.operators import balance, contrastive, lookups, merge, negatives, order, report, retrieval, rewards, serving, turns, validate
from reelquery.sources import adapters, jsonl, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_rank_is_optimistic_under_ties(spark):
    s = spark.createDataFrame([(1, d, x) for d, x in enumerate([0.9, 0.5, 0.5, 0.1])], "qid int, doc int, score double")
    p = spark.createDataFrame([(1, 2)], "qid int, pos int")
    assert retrieval.optimistic_rank(s, p).first()["rank"] == 2
    assert [r["doc"] for r in retrieval.top_k(s, 2).orderBy("rank").collect()] == [0, 1]
    assert retrieval.top_1(s).first()["doc"] == 0


def test_rank_metrics_over_valid_ranks(spark):
    r = retrieval.rank_metrics(spark.createDataFrame([(1,), (3,), (None,), (0,), (12,)], "rank int"), "rank").first()
    assert (r["n"], r["r_at_1"], r["r_at_5"], r["r_at_10"]) == (3, round(1 / 3, 6), round(2 / 3, 6), round(2 / 3, 6))
    assert r["mrr"] == round((1 + 1 / 3 + 1 / 12) / 3, 6)


def test_empty_ranks(spark):
    r = retrieval.rank_metrics(spark.createDataFrame([], "rank int"), "rank").first()
    assert r["n"] == 0 and r["mrr"] is None


def test_topk_blocks_equals_sql(spark):
    rng = np.random.default_rng(1)
    q = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(5)], "qid bigint, qvec array<double>")
    c = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(60)], "doc bigint, dvec array<double>")
    a = {(r.qid, r.rank): r.doc for r in retrieval.top_k(retrieval.scores(q, c), 7).collect()}
    b = {(r.qid, r.rank): r.doc for r in retrieval.top_k_blocks(q, c, 7).collect()}
    assert a == b and len(a) == 35
    assert retrieval.top_k_blocks(q.limit(0), c, 3).count() == 0
    assert retrieval.top_k_blocks(q, c, 100).count() == 300  # fewer rows than k: no padding


def test_two_overlaps_of_reversed_spans(spark):
    four = [F.lit(x) for x in (2.0, 6.0, 8.0, 4.0)]
    assert one(spark, temporal.iou_swapping(*four)) == pytest.approx(1 / 3)
    assert one(spark, temporal.iou_strict(*four)) == 0
    assert one(spark, temporal.iou_or_null(*four)) is None
    assert one(spark, temporal.iou_swapping(*[F.lit(x) for x in (1.0, 1.0, 0.0, 2.0)])) == 0


@pytest.mark.parametrize("x, said", [(3.0, "3.0"), (2.5, "2.5"), (1.23456789, "1.234568"), (0.0, "0.0")])
def test_seconds(spark, x, said):
    assert one(spark, temporal.seconds_text(F.lit(x))) == said


@pytest.mark.parametrize("time, want", [([1.0], None), ([3.0, 1.0], None), ([1.0, 2.0, 9.0], (1.0, 2.0)), ([math.nan, 2.0], None), ([0.0, math.inf], None)])
def test_span(spark, time, want):
    got = one(spark, temporal.span(F.array(*[F.lit(x) for x in time])))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("text, key", [("  A  b\t", "a b"), (" X y ", "x y"), ("", "")])
def test_text_key(spark, text, key):
    assert one(spark, parse.text_key(F.lit(text))) == key


@pytest.mark.parametrize("qid, desc", [("12_fig", "12"), ("12_fig_7", "12"), ("v_12", None), ("12", "12")])
def test_description_id(spark, qid, desc):
    assert one(spark, parse.description_id(F.lit(qid))) == desc


@pytest.mark.parametrize("said, label", [("unmatched", "neg"), ("does not match", "neg"), ("notebook", ""), ("It matches", "pos"), ("NO_MATCH", "neg"), (None, "")])
def test_labels(spark, said, label):
    assert one(spark, parse.binary_label(F.lit(said).cast("string"))) == label


def test_response_with_label_in_tags_only(spark):
    p = one(spark, parse.full_response(F.lit("<ANSWER>match</ANSWER><answer>not_matched</answer><start>1</start>")))
    assert p["label"] == "" and not p["parsed_ok"]
    p = one(spark, parse.full_response(F.lit("<think>x</think>Label: matched\nreasoning: a  b\ntemporal: 3-5")))
    assert (p["label"], p["reasoning"], p["start"], p["end"]) == ("matched", "a b", 3.0, 5.0)


def test_boxed_and_search(spark):
    assert one(spark, parse.boxed(F.lit(r"\boxed{1} \boxed{a{b}c}"))) == "a{b}c"
    assert one(spark, parse.boxed(F.lit("none"))) is None
    assert one(spark, parse.search_text(F.lit("<search>a</search> <search> b"))) == "a"
    assert one(spark, parse.search_text(F.lit("x <Search> b "))) == "b"


def test_safe_numbers(spark):
    for text, keep, null in (("nan", None, None), ("inf", math.inf, None), ("2", 2.0, 2.0), ("x", None, None)):
        assert one(spark, parse.safe_number(F.lit(text))) == keep
        assert one(spark, parse.safe_number(F.lit(text), "null")) == null
    assert one(spark, parse.safe_number(F.lit("-inf"), "zero")) == 0


def test_numbers_of():
    assert parse.numbers_of("10, 1,5,5") == [1, 5, 10]
    with pytest.raises(ValueError):
        parse.numbers_of("0,1")


def test_advantages_of_a_pair(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 0.0)], "g int, r double")
    got = sorted(x["advantage"] for x in rewards.advantages(df, "g", "r").collect())
    assert got == pytest.approx([-0.5 / (math.sqrt(0.5) + 1e-4), 0.5 / (math.sqrt(0.5) + 1e-4)])


def test_not_matched_without_tags_is_half(spark):
    turn = F.array(F.struct(F.lit(False).alias("shadow"), F.lit("not_matched").alias("answer"), F.lit("v").alias("retrieved_id"), F.lit(False).alias("correct_accept"), F.lit(True).alias("correct_reject"), F.lit(True).alias("has_refine_token")))
    assert one(spark, rewards.time_iou(F.lit("x"), turn, F.array(F.lit(0.0), F.lit(1.0)))) == 0.5
    assert one(spark, rewards.time_format(F.lit("x"), turn)) == 1
    assert one(spark, rewards.answer_binary(turn, F.lit("w"))) == 1
    assert one(spark, rewards.answer_binary(turn, F.lit("v"))) == -1


def test_final_turn_of_shadows(spark):
    t = spark.createDataFrame([Row(turns=[Row(shadow=True, n=1), Row(shadow=True, n=2)])])
    assert t.select(turns.final_turn(F.col("turns"))["n"]).first()[0] == 2
    assert t.select(turns.final_turn(F.slice("turns", 1, 0))["n"]).first()[0] is None


def _turns(spark, ranks):
    return spark.createDataFrame([(1, i + 1, r, None, False, 9) for i, r in enumerate(ranks)], "idx int, pos int, rank int, policy_rank int, refine_applied boolean, final_rank int")


def test_carry_forward(spark):
    p = turns.policy_rank(_turns(spark, [4, 2]))
    got = {r["turn"]: r["policy"] for r in turns.carried_forward(p, 3).collect()}
    assert got == {1: 4, 2: 2, 3: 2}
    assert p.where("pos = 3").count() == 0


def test_policy_rank_after_refinement(spark):
    rows = [(1, 1, 5, 0, True, 7), (1, 2, 3, None, True, 7), (2, 1, 0, None, False, 7)]
    df = spark.createDataFrame(rows, "idx int, pos int, rank int, policy_rank int, refine_applied boolean, final_rank int")
    assert [(r.idx, r.pos, r.policy) for r in turns.policy_rank(df).orderBy("idx", "pos").collect()] == [(1, 1, 3), (1, 2, 7)]


def test_cap_of_zero_in_two_ways(spark):
    s = spark.createDataFrame([(1, d, 1.0 / (d + 1)) for d in range(5)], "qid int, doc int, score double")
    p = spark.createDataFrame([(1, 0)], "qid int, pos int")
    assert negatives.hard_negatives(s, p, 10, 0).count() == 4
    assert len(negatives.negatives_with_ranks(s, p, 0, 3).first()["ids"]) == 1
    assert [r["raw_rank"] for r in negatives.hard_negatives(s, p, 10, 2).orderBy("place").collect()] == [2, 3]


def test_random_negatives(spark):
    docs = spark.range(50).withColumnRenamed("id", "doc")
    q = spark.createDataFrame([(i, i) for i in range(6)], "qid bigint, pos bigint")
    a = negatives.random_negatives(docs, q, 7, seed=1).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, negatives.random_negatives(docs, q, 7, seed=1).collect()))
    assert len(a) == 42 and len({(r.qid, r.doc) for r in a}) == 42 and all(r.qid != r.doc for r in a)


def test_upsample_cycles(spark):
    c = spark.createDataFrame([(i,) for i in range(4)], "k int")
    got = balance.upsampled(3, 10, c, "k", 1.0).collect()
    assert len(got) == 7 and sorted(r["cycle"] for r in got) == [0] * 4 + [1] * 3
    assert balance.upsampled(10, 3, c, "k", 1.0).count() == 0
    assert balance.upsampled(0, 3, c.limit(0), "k", 1.0).count() == 0


def test_stratified_errors(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, l string")
    with pytest.raises(ValueError):
        balance.stratified(df, "l", "k", {"a": 2, "b": 1}, allow_smaller=False)
    assert balance.stratified(df, "l", "k", {"a": 0}).count() == 1
    assert balance.balanced(df.where("l = 'a'"), "l", "k", "a", "b").count() == 1


def test_first_and_last_wins(spark):
    m = spark.createDataFrame([("q", 0, "a"), ("q", 1, "b"), ("q", 2, "")], "key string, ord int, v string")
    left = spark.createDataFrame([("q",)], "key string")
    assert lookups.by_text(left, m, "key", "ord", "first").first()["v"] == "a"
    assert lookups.by_text(left, m, "key", "ord", "last").first()["v"] == ""
    assert lookups.last_filled(m, "key", "ord", ["v"]).first()["v"] == "b"


def test_log_rows_without_a_key(spark):
    df = spark.createDataFrame([(0, None, " "), (1, None, None), (2, 5, "x"), (3, 5, "y")], "ord int, idx int, qid string")
    assert merge.latest_log(df, "idx", "qid", "ord").count() == 3
    assert merge.latest_log(df, "idx", "qid", "ord", collapse=True).count() == 2


def test_matrix_shards(spark):
    a = spark.createDataFrame([("x", [1.0, 2.0], 0)], "doc string, vec array<double>, row bigint")
    with pytest.raises(ValueError):
        merge.merge_matrices(a, a)
    with pytest.raises(ValueError):
        merge.merge_matrices(a, spark.createDataFrame([("y", [1.0], 0)], "doc string, vec array<double>, row bigint"))


def test_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted((r.id, r.at) for r in order.numbered(df, ["k", "id"], "at").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and sorted(a for _, a in got[0]) == list(range(100))


def test_query_ids_collide_in_second_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a_2")], "line int, qid string")
    assert sorted(r.qid for r in validate.unique_qids(df, "qid", "line").collect()) == ["a", "a_2", "a_2"]


def test_contrastive_by_hand(spark):
    negs = [0.2, 0.1]
    z = sum(math.exp(x / 0.1) for x in negs)
    a = F.array(*[F.lit(x) for x in negs])
    assert one(spark, contrastive.quality(F.lit(0.5), a, 0.1)) == pytest.approx(0.5 - 0.1 * math.log(z))
    assert one(spark, contrastive.positive_probability(F.lit(0.5), a, 0.1)) == pytest.approx(math.exp(5) / (math.exp(5) + z))
    r = one(spark, contrastive.clipped_surrogate(F.lit(0.5), F.lit(0.0), F.lit(1.0)))
    assert (r["objective"], r["clipped"]) == (pytest.approx(1.2), True)


def test_normalise_zero_vector(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vector.normalize(zero)) == [0.0, 0.0]
    assert one(spark, vector.normalize(zero, "keep")) == [0.0, 0.0]


def test_frames(spark):
    assert one(spark, sampling.nearest(F.array(F.lit(2), F.lit(6), F.lit(4)), F.lit(5))) == 6
    assert one(spark, sampling.smart_frames(F.lit(1), F.lit(30.0))) is None
    assert one(spark, sampling.even_spread(F.lit(0), F.lit(9), F.lit(4))) == [0, 3, 6, 9]


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": null}\n\n{bad\n[1]\n{"a": 1.5}\n')
    path = str(tmp_path / "a.jsonl")
    rows = jsonl.read_jsonl(spark, path, "a int, b string").orderBy("ord").collect()
    assert len(rows) == 2 and rows[0]["a"] == 1
    assert tuple(jsonl.bad_lines(spark, path).first()) == (2, 2)
    with pytest.raises(Exception, match="no JSON object"):
        jsonl.read_jsonl(spark, path, "a int", mode="strict").collect()
    (tmp_path / "b.json").write_text('[{"a": 1}, 3, {"a": 2}]')
    assert [r["a"] for r in jsonl.read_any(spark, str(tmp_path / "b.json"), "a int").collect() if r["a"]] == [1, 2]
    (tmp_path / "c.json").write_text('{"data": [{"a": 4}]}')
    assert [r["a"] for r in jsonl.read_any(spark, str(tmp_path / "c.json"), "a int").collect()] == [4]
    (tmp_path / "m.json").write_text('{"y": 1, "x": 0}')
    assert [tuple(r) for r in jsonl.id_rows(spark, str(tmp_path / "m.json")).collect()] == [("x", 0), ("y", 1)]


def test_matrix_file(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    got = jsonl.read_matrix(spark, str(tmp_path / "m.npy"), spark.range(3)).orderBy("row").collect()
    assert [r["vec"] for r in got] == [[0, 1], [2, 3], [4, 5]]
    with pytest.raises(ValueError):
        jsonl.read_matrix(spark, str(tmp_path / "m.npy"), spark.range(2))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "é")], "a int, b string, c string")
    sinks.write_jsonl(df, str(tmp_path / "out"))
    text = "".join(f.read_text() for f in (tmp_path / "out").glob("part*"))
    assert json.loads(text) == {"a": 1, "b": None, "c": "é"} and "é" in text
    for n in (1, 2):
        assert sinks.replace_whole(spark.range(n), str(tmp_path / "whole")) == n
    assert sinks.read_whole(spark, str(tmp_path / "whole")).count() == 2 and sinks.read_whole(spark, str(tmp_path / "whole"), 1).count() == 1
    for text in ("a", "bé"):
        sinks.replace_file(spark, str(tmp_path / "one.json"), text)
    assert (tmp_path / "one.json").read_text() == "bé" and not list(tmp_path.glob("one.json.tmp*"))
    table = sinks.write_leaderboard(spark.createDataFrame([("x", 0.5)], "label string, score double"), str(tmp_path / "board"))
    assert table.splitlines()[2] == "| x | 0.5000 |"
    assert sinks.upsert_block("a: 1\nb:\n  c: 2\nd: 3\n", "b", "b: 9") == "a: 1\nb: 9\nd: 3\n"
    assert sinks.upsert_block("a: 1\n", "b", "b: 2") == "a: 1\nb: 2\n"


def test_adapters(spark):
    assert len(adapters.ADAPTERS) == 15
    with pytest.raises(ValueError):
        adapters.adapter("other")
    assert adapters.adapter("Verified-Search-x").kind == "verified search"


def test_markdown_and_lists(spark):
    assert report.markdown(spark.createDataFrame([("a", 1)], "k string, n int")) == "| k | n |\n| --- | --- |\n| a | 1 |\n"
    m = spark.createDataFrame([(1, 0.5), (3, 0.75)], "turn int, r double")
    assert report.deltas(m, "turn", ["r"]).first()[0] == 0.25


def test_stop_reasons(spark):
    cases = {("matched", True, True, 1): "matched", ("x", True, True, 1): "continue_refine", ("x", True, True, 3): "max_turn_reached_with_refine", ("x", True, False, 1): "refine_token_no_update", ("not_matched", False, False, 1): "not_matched_no_refine_token", ("x", False, False, 1): "unknown_no_refine_token"}
    for (a, tok, upd, n), want in cases.items():
        assert one(spark, turns.stop_reason(F.lit(a), F.lit(tok), F.lit(upd), F.lit(n), 3)) == want


def test_numbers_beyond_the_sample(spark, monkeypatch):
    """More rows than the bounds are taken from, ties of many rows, and branches that read different columns."""
    monkeypatch.setattr(order, "_SAMPLED", 1)
    df = spark.range(5000).select(F.pmod(F.col("id") * 7919, F.lit(5000)).alias("k"), F.when(F.col("id") < 2000, 3).otherwise(F.col("id")).alias("tie"), F.sha2(F.col("id").cast("string"), 256).alias("wide"), (F.col("id") % 3).alias("v"))
    got = order.numbered(df, ["k"], "at", start=1).select("k", "at").collect()
    assert sorted((r["k"], r["at"]) for r in got) == [(i, i + 1) for i in range(5000)]
    tied = order.numbered(df, ["tie"], "at").collect()
    assert [r["at"] for r in sorted(tied, key=lambda r: r["at"])] == list(range(5000))
    assert [r["tie"] for r in sorted(tied, key=lambda r: r["at"])] == sorted(r["tie"] for r in tied)
    ranges = order.in_ranges(df, ["tie"]).where("tie = 3").groupBy("__part").count().collect()
    assert len(ranges) > 5  # one value of 2,000 rows isn't one task
    upto = {r["k"]: r["s"] for r in order.running(df, ["k"], sums={"s": "v"}).select("k", "s").collect()}
    by = {r["k"]: r["v"] for r in df.collect()}
    total = 0
    for k in range(5000):
        total += by[k]
        assert upto[k] == total
    assert order.numbered(df.limit(0), ["k"], "at").count() == 0


def test_retries_and_progress(spark):
    rows = [("a", 1, None, None, "e1"), ("a", 2, True, "x", None), ("b", 1, False, None, "e1"), ("b", 2, False, None, "e2"), ("b", 3, True, "late", None), ("c", 1, True, None, None)]
    attempts = spark.createDataFrame(rows, "key string, at int, ok boolean, content string, error string")
    got = {r.key: tuple(r)[1:] for r in serving.with_retries(attempts, "key", "at", 1).collect()}
    assert got == {"a": ("x", None, 2), "b": ("", "e2", 2), "c": (None, None, 1)}
    assert serving.with_retries(attempts.limit(0), "key", "at", 1).count() == 0
    one = spark.range(1).select(serving.progress(F.lit(5), F.lit(20), F.lit(10.0)).alias("p"), serving.progress(F.lit(0), F.lit(0), F.lit(0.0)).alias("z")).first()
    assert tuple(one.p) == (25.0, 0.5, 30.0) and tuple(one.z) == (0.0, 0.0, 0.0)


def test_refresh(spark):
    steps = spark.createDataFrame([(0, 1), (9, 1), (10, 1), (19, 2), (20, None)], "step int, qid int")
    mined = spark.createDataFrame([(1, 0, 7), (1, 10, 8), (2, 0, 9)], "qid int, point int, neg int")
    assert {(r.step, r.neg) for r in serving.refreshed(steps, mined, 10).collect()} == {(0, 7), (9, 7), (10, 8), (19, None), (20, None)}
    assert {(r.step, r.neg) for r in serving.refreshed(steps, mined, 0).collect()} == {(0, 7), (9, 7), (10, 7), (19, 9), (20, None)}
    due = lambda every, last: [r.step for r in steps.where(serving.refresh_due(F.col("step"), F.lit(last), every)).orderBy("step").collect()]
    assert due(10, None) == [10, 20] and due(10, 20) == [10] and due(0, None) == []
