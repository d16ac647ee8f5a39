"""The forms for large data against plain ones: grid join, exact quantiles, keyed draws, mixed bags, JSON documents and matrices."""

import json
import random
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquery.functions.permute import half_bits, permuted
from reelquery.operators import grid, lookups, negatives, quantiles, retrieval
from reelquery.sources import documents, jsonl, matrix


def vectors(rng, n, name, vec, copies=0):
    rows = [(i, [round(rng.gauss(0, 1), 1) for _ in range(6)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(copies)]
    return rows, f"{name} bigint, {vec} array<float>"


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(grid, "QUERY_BYTES", 48 * 7)
    monkeypatch.setattr(grid, "CORPUS_BYTES", 48 * 9)
    monkeypatch.setattr(grid, "ROWS", 3)
    monkeypatch.setattr(grid, "FAN", 3)


def test_grid_equals_all_pairs(spark, small_blocks):
    rng = random.Random(4)
    docs = spark.createDataFrame(*vectors(rng, 150, "doc", "dvec", copies=60))
    queries = spark.createDataFrame(*vectors(rng, 25, "qid", "qvec"))
    assert grid.sizes(queries, docs)[0] > 3 and grid.sizes(queries, docs)[1] > 20
    scored = retrieval.scores(queries, docs)
    row = lambda df: sorted(map(tuple, df.select("qid", "doc", "score", "rank").collect()))
    assert row(retrieval.top_k_blocks(queries, docs, 7)) == row(retrieval.top_k(scored, 7))
    assert row(retrieval.top_k_blocks(queries, docs, 7, self_match=False)) == row(retrieval.top_k(scored.where("qid <> doc"), 7))
    assert len(row(retrieval.top_k_blocks(queries, docs, 500))) == 25 * 210
    pos = spark.createDataFrame([(i, (i * 37) % 210) for i in range(24)] + [(24, 999)], "qid bigint, pos bigint")
    for own in (True, False):
        some = scored if own else scored.where("qid <> doc")
        want = {r["qid"]: r["rank"] for r in retrieval.optimistic_rank(some, pos).collect()}
        got = {r["qid"]: r["rank"] for r in grid.ranks(queries, docs, pos, self_match=own).collect()}
        assert {q: r for q, r in got.items() if q in want} == want and 24 not in got
    assert retrieval.top_k_blocks(queries.limit(0), docs, 3).count() == 0 and retrieval.top_k_blocks(queries, docs.limit(0), 3).count() == 0


def test_scores_beyond_a_broadcast_meet_by_blocks(spark, monkeypatch):
    rng = random.Random(5)
    docs, queries = spark.createDataFrame(*vectors(rng, 40, "doc", "dvec")), spark.createDataFrame(*vectors(rng, 10, "qid", "qvec"))
    want = sorted(map(tuple, retrieval.scores(queries, docs).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 0)
    found = retrieval.scores(queries, docs)
    assert sorted(map(tuple, found.collect())) == want
    assert "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


def test_grid_plan_has_no_pairs(spark):
    rng = random.Random(6)
    docs, queries = spark.createDataFrame(*vectors(rng, 40, "doc", "dvec")), spark.createDataFrame(*vectors(rng, 10, "qid", "qvec"))
    plan = grid.nearest(queries, docs, 3)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.8, 1.0])
def test_quantiles_are_exact(spark, monkeypatch, q):
    monkeypatch.setattr(quantiles, "FEW", 5)
    monkeypatch.setattr(quantiles, "ACCURACY", 20)
    rng = random.Random(q)
    for values in ([rng.gauss(0, 1) for _ in range(501)], [1.0] * 60 + [2.0] * 40, [1.0] * 50 + [2.0] * 50, [3.5], [float(rng.choice([1, 1, 1, 2, 9])) for _ in range(300)], [1e300, -1e300, 1e-300, 0.0, 5e-324] * 20):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(5)
        assert quantiles.exact(df, F.col("v"), q) == df.agg(F.percentile("v", q)).first()[0], values[:3]
    assert quantiles.exact(df.limit(0), F.col("v"), q) is None
    whole = spark.range(997)
    assert quantiles.exact(whole, F.col("id"), 0.5) == 498.0


def test_rank_report_is_empty_without_ranks(spark):
    df = spark.createDataFrame([(None,), (0,), (-1,)], "rank int")
    assert retrieval.rank_report(df, "rank").count() == 0 and retrieval.rank_metrics(df, "rank").first()["n"] == 0
    ranks = [1, 4, 4, 9, 2, 11]
    got = retrieval.rank_report(spark.createDataFrame([(r,) for r in ranks], "rank int"), "rank").first()
    assert got["median_rank"] == statistics.median(ranks) and got["n"] == 6


def test_permutations_are_whole_and_differ(spark):
    n = 50
    size = 1 << 2 * half_bits(n)
    df = spark.range(size).crossJoin(spark.range(200).withColumnRenamed("id", "key"))
    at = defaultdict(dict)
    for i, key, v in permuted(df, "id", "key", n, 1, "at").select("id", "key", "at").collect():
        at[key][i] = v
    assert all(sorted(p.values()) == list(range(size)) for p in at.values())
    assert len({tuple(p[i] for i in range(6)) for p in at.values()}) == 200
    first = Counter(p[0] for p in at.values())
    assert max(first.values()) < 15


def test_random_negatives_are_uniform_and_fill(spark):
    docs = spark.range(40).withColumnRenamed("id", "doc")
    q = spark.range(3000).select(F.col("id").alias("qid"), (F.col("id") % 40).alias("pos"))
    got = negatives.random_negatives(docs, q, 4, seed=2).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["place"]):
        by[r["qid"]].append(r["doc"])
    assert all(len(v) == len(set(v)) == 4 and k % 40 not in v for k, v in by.items()) and len(by) == 3000
    assert len({tuple(v) for v in by.values()}) > 2900  # queries share no window
    for place in range(4):
        seen = Counter(v[place] for v in by.values())
        chi = sum((seen[d] - 75) ** 2 / 75 for d in range(40))
        assert chi < 80  # 39 degrees of freedom
    banned = spark.range(35).select(F.lit(1).cast("bigint").alias("qid"), F.col("id").alias("doc"))
    one = spark.createDataFrame([(1, 39)], "qid bigint, pos bigint")
    assert sorted(r["doc"] for r in negatives.random_negatives(docs, one, 10, 0, banned).collect()) == [35, 36, 37, 38]
    everything = negatives.random_negatives(docs, one, 100).collect()
    assert sorted(r["doc"] for r in everything) == list(range(39)) and sorted(r["place"] for r in everything) == list(range(1, 40))
    assert negatives.random_negatives(docs.limit(0), one, 3).count() == 0


def test_linear_fill_follows_the_draws(spark, monkeypatch):
    """Where the tries are used up, what is missing comes in order of the docs."""
    docs = spark.range(3000).withColumnRenamed("id", "doc")
    one = spark.createDataFrame([(1, 0)], "qid bigint, pos bigint")
    real = negatives.permuted
    monkeypatch.setattr(negatives, "permuted", lambda df, i, key, n, seed, name: real(df, i, key, n, seed, name).where(F.col(i) < 5))
    got = {r["place"]: r["doc"] for r in negatives.random_negatives(docs, one, 20).collect()}
    assert sorted(got) == list(range(1, 21)) and len(set(got.values())) == 20 and 0 not in got.values()
    tail = [got[p] for p in sorted(got) if got[p] < 40]
    assert tail == sorted(tail) and len(tail) > 10


def brute_bag(requests, meta):
    used, out = set(), {}
    for query, pos, o in sorted(requests, key=lambda r: r[2]):
        for q, p, m in sorted(meta, key=lambda r: r[2]):
            if query and q == query and (not pos or (p or "") == pos) and m not in used:
                used.add(m)
                out[o] = m
                break
    return out


@pytest.mark.parametrize("seed", range(3))
def test_bags_follow_the_requests_order(spark, seed):
    rng = random.Random(seed)
    requests = [(rng.choice(["a", "b", "c", "d", "", None]), rng.choice(["", None, "x", "y"]), i) for i in range(80)]
    requests = [(q, {"c": "x", "d": ""}.get(q, p), o) for q, p, o in requests]
    meta = [(rng.choice("abcde"), rng.choice(["x", "y", "z", None]), 100 + i) for i in range(70)]
    shape = "query string, pos string, ord bigint"
    r, m = spark.createDataFrame(rng.sample(requests, 80), shape), spark.createDataFrame(rng.sample(meta, 70), shape)
    found = lookups.bag_match(r, m, "query", "pos", "ord")
    want = brute_bag(requests, meta)
    assert {x["ord"]: x["meta_ord"] for x in found.collect()} == want and found.count() == len(want)
    skips = {x["reason"]: x["n"] for x in lookups.bag_skips(r, found, "query", "pos", "ord").collect()}
    assert sum(skips.values()) == 80 - len(want) and skips["query_empty"] == sum(not q for q, _, _ in requests)


def value(rng, depth=0):
    k = rng.random()
    if depth < 3 and k < 0.3:
        return {rng.choice(["a", "b,", 'c"', "data", "é\\"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}
    if depth < 3 and k < 0.5:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([1, None, True, "x", "a,b", "}{][", '"q"', "\\", '\\"', ",", "\n", '{"data": [1,2]}', "", 1.5])


@pytest.fixture
def tiny_ranges(spark):
    for k, v in (("spark.sql.files.maxPartitionBytes", "600"), ("spark.sql.files.openCostInBytes", "100")):
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


@pytest.mark.parametrize("seed", [1])
def test_documents_are_cut_like_a_parser_does(spark, tmp_path, tiny_ranges, seed):
    rng = random.Random(seed)
    rows = [{"i": i, "v": value(rng), "t": rng.choice(["a,b", '"', "\\", "[{", "ok"])} for i in range(50)]
    forms = {
        "array.json": json.dumps(rows),
        "pretty.json": json.dumps(rows, indent=2, ensure_ascii=False),
        "data.json": json.dumps({"data": rows}),
        "late.json": json.dumps({"meta": {"data": [1, 2], "z": [{"data": [3]}]}, "data": rows, "tail": [{"q": 1}]}, indent=1),
        "lines.jsonl": "\n".join(map(json.dumps, rows)),
        "lines.json": "\n".join(map(json.dumps, rows)),
    }
    for name, text in forms.items():
        (tmp_path / name).write_text(text)
        got = jsonl.read_any(spark, str(tmp_path / name), "i int, t string").orderBy("ord").collect()
        assert [(r["i"], r["t"]) for r in got] == [(r["i"], r["t"]) for r in rows], name
    whole = documents.members(spark, str(tmp_path / "array.json")).orderBy("place").collect()
    assert [json.loads(r["text"]) for r in whole] == rows
    assert documents.pieces(spark, str(tmp_path / "array.json")).select("block").distinct().count() > 3  # several tasks read one file


def test_documents_of_odd_forms(spark, tmp_path):
    cases = {"a.json": ('{"data": 1, "x": 2}\n{"data": 3, "x": 4}\n', [2, 4]), "b.json": ("[]", []), "c.json": ('{"data": []}', []), "d.json": ('[1, {"x": 5}, [2], "x"]', [5]), "e.jsonl": ('{"data": [{"x": 1}]}\n', [None]), "f.json": (' {"k": 0,\n "data": [ {"x": 1} , {"x": 2} ] }\n', [1, 2]), "g.json": ('﻿[{"x": 1}]', [1])}
    for name, (text, want) in cases.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
        assert [r["x"] for r in jsonl.read_any(spark, str(tmp_path / name), "x int").orderBy("ord").collect()] == want, name
    for text in ("[1, 2", '[{"a": 1}, {"b": [}]'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(ValueError, match="doesn't end"):
            jsonl.read_any(spark, str(tmp_path / "bad.json"), "a int")
    ids = {f'k{i},"': i for i in range(100)}
    (tmp_path / "ids.json").write_text(json.dumps(ids))
    assert [tuple(r) for r in jsonl.id_rows(spark, str(tmp_path / "ids.json")).collect()] == list(ids.items())


def test_matrices_are_read_by_ranges_of_rows(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(100_000, 3)).astype(np.float64)
    np.save(tmp_path / "x.npy", x)
    m = jsonl.read_matrix(spark, str(tmp_path / "x.npy"), rows=9000)
    tasks = m.groupBy(F.spark_partition_id()).agg(F.min("row"), F.max("row"), F.count(F.lit(1))).collect()
    assert len(tasks) == 12 and all(r[2] - r[1] + 1 == r[3] <= 9000 for r in tasks)
    got = {r["row"]: r["vec"] for r in m.where("row % 9999 = 0").collect()}
    assert len(got) == 11 and all(np.array_equal(np.float32(v), x[i].astype(np.float32)) for i, v in got.items())
    matrix.write_matrix(m.where("row < 70000"), str(tmp_path / "folder"), 3)
    back = jsonl.read_matrix(spark, str(tmp_path / "folder"), rows=50_000)
    assert back.count() == 70_000 and back.join(m, ["row", "vec"]).count() == 70_000
    meta = spark.range(5).select(F.col("id").alias("ord"), (F.col("id") * 2).alias("v"))
    assert sorted((r["row"], r["v"]) for r in jsonl.with_meta(m, meta).collect()) == [(i, 2 * i) for i in range(5)]
    for name, bad in (("f", np.asfortranarray(np.ones((3, 2)))), ("one", np.ones(3))):
        np.save(tmp_path / f"{name}.npy", bad)
        with pytest.raises(Exception, match="row order"):
            jsonl.read_matrix(spark, str(tmp_path / f"{name}.npy")).count()
    with pytest.raises(Exception, match=r"(?i)not.?found|no such"):
        jsonl.read_matrix(spark, str(tmp_path / "none.npy")).count()
    np.save(tmp_path / "empty.npy", np.ones((0, 4)))
    assert jsonl.read_matrix(spark, str(tmp_path / "empty.npy")).count() == 0
