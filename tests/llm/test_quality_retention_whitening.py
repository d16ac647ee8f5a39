"""Operators 11 to 13 against SQL and brute force, on awkward tables, and the plans that they promise."""

import datetime as dt
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from reelquery.llm import quality, queries, retention, whitening
from reelquery.llm.common import new_path

SF = "/root/testdata/sf0.001"


def rows_of(df, key):
    return {r[key]: r for r in df.collect()}


# Quality rules


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    hit = {p for at in places.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = duck.execute(queries.oracle_sql()["op11_quality"])
    names = [d[0] for d in cur.description]
    got = queries.op11_quality(spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cur.fetchall())


def test_quality_equals_brute_force_on_awkward_texts(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "a", "a\nb\na\n\nb\na", "\x0b\x0c\r# * $ %", "é " * 40, "one two three four five six seven eight " * 5, "x" * 100_000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["".join(rng.choice("ab \n#é") for _ in range(rng.randrange(400))) for _ in range(40)]
    texts.append(" ".join(str(rng.randrange(300)) for _ in range(200_000)) + " " + " ".join(map(str, range(30))) + " x " + " ".join(map(str, range(30))))
    df = spark.createDataFrame([(i, t, 1, "q", 2) for i, t in enumerate(texts)], "doc_id int, text string, n_words int, quality string, t int")
    got = rows_of(quality.judged(df), "doc_id")
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        q = got[i]["quality"]
        n, chars, symbols, dup, repeat = brute_quality(t)
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == (n, chars, symbols, dup, repeat), i
        assert q["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
        assert q["kept"] == (not q["failed"]) and (not q["base_failed"] or not q["kept"])
        assert (got[i]["n_words"], got[i]["t"]) == (1, 2)
    assert sorted(r["doc_id"] for r in quality.keep_good(df).collect()) == [i for i in got if got[i]["quality"]["kept"]]
    assert quality.keep_good(df).columns == df.columns


def test_quality_rules_come_from_a_table(spark):
    table = spark.createDataFrame([("short", "n_words", "one", 300, None, None), ("signs", "n_symbols", "n_words", None, 50, 2)], "name string, measure string, per string, at_least int, at_most int, from_words int")
    rules = quality.rules_of(table)
    docs = spark.createDataFrame([(1, "a b"), (2, "a b c"), (3, "# # a"), (4, "#"), (5, None)], "doc_id int, text string")
    got = rows_of(quality.judged(docs, base=(), rules=rules), "doc_id")
    assert {i: r["quality"]["failed"] for i, r in got.items()} == {1: ["short"], 2: [], 3: ["signs"], 4: ["short"], 5: ["short"]}
    with pytest.raises(ValueError):
        quality.rules_of(table, most=1)


def test_quality_is_one_projection(spark):
    plan = queries.op11_quality(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Generate|Join|Aggregate", plan)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert quality.op11(empty).collect() == []


# Cohort retention

CLICKS = "click_id bigint, ts timestamp_ntz, arrived_at timestamp_ntz, client_id bigint, kind string, value double, props string, slice int, k0 string, tags array<int>"
CLIENTS = "client_id bigint, updated_at timestamp_ntz, city string, slice int"


def shop(rng, n, hot=0.4):
    start = dt.datetime(2024, 1, 1)
    clicks, clients = [], [(i, start, rng.choice([None, "A", "B", ""]), 9) for i in range(0, 30, 2)]
    clients += [(0, start + dt.timedelta(1), "late", 1), (0, None, "never", 1), (None, start, "none", 1)]
    for i in range(n):
        who = 7 if rng.random() < hot else rng.choice([*range(30), None])
        ts = None if rng.random() < 0.02 else start + dt.timedelta(microseconds=rng.randrange(100 * 86_400_000_000))
        arrived = None if ts is None or rng.random() < 0.02 else ts + dt.timedelta(seconds=rng.randrange(100))
        kind = rng.choice(["purchase", "view", "click", None])
        value = rng.choice([None, float("nan"), float("inf"), round(rng.uniform(-50, 500), 2), 0.005])
        clicks.append((i if rng.random() < 0.98 else None, ts, arrived, who, kind, value, rng.choice(["{}", None]), i, "x", [i % 2]))
    return clicks + rng.sample(clicks, n // 20), clients


def brute_retention(clicks, clients, days=3):
    width, epoch = days * 86_400_000_000, dt.datetime(1970, 1, 1)
    us = lambda t: (t - epoch) // dt.timedelta(microseconds=1)
    crc = lambda x: zlib.crc32(str(x).encode())
    seen, rows = set(), []
    for r in clicks:
        if (key := repr(r)) in seen or r[1] is None or r[3] is None:
            continue
        seen.add(key)
        h = crc(r[0]) if r[0] is not None else 1
        known = r[2] is not None and us(r[2]) + (h % 100 if h % 3 == 0 else 0) * 86_400_000_000 < us(dt.datetime(2024, 3, 1))
        value = r[5]
        cents = 0 if value is None or value != value or abs(value) == float("inf") else int(np.floor(100 * value + 0.5))
        rows.append((r[3], us(r[1]), known, r[4], cents))
    city = {}
    for c in sorted((c for c in clients if c[0] is not None), key=lambda c: (c[1] or dt.datetime.min, c[2] or "")):
        city[c[0]] = c[2] or ""
    start = [{}, {}]
    for who, at, known, kind, _ in rows:
        for k in (0, 1):
            if kind == "purchase" and (k or known):
                start[k][who] = min(at, start[k].get(who, at))
    cells = defaultdict(lambda: defaultdict(int))
    for who, at, known, _, cents in rows:
        for k in (0, 1):
            if (k or known) and who in start[k] and at >= start[k][who]:
                s = start[k][who]
                cells[k, city.get(who, ""), s // width, (at - s) // width][who] += cents
    moved = {w for w in start[0] if start[0][w] // width != start[1][w] // width}
    return sorted((*key, len(v), sum(map(crc, v)), len(moved & set(v)), sum(v.values())) for key, v in cells.items())


def result(df):
    return sorted(tuple(r) for r in df.select("state", "segment", "cohort", "period", "users", "users_crc32", "moved", "cents").collect())


@pytest.mark.parametrize("n", [0, 3, 4000])
def test_retention_equals_brute_force(spark, n):
    clicks, clients = shop(random.Random(n), n)
    got = result(retention.op12(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(clients, CLIENTS)))
    want = brute_retention(clicks, clients)
    assert got == want
    assert n < 100 or (any(r[6] for r in want) and len(want) > 100)


def test_retention_equals_sql_and_ignores_the_zone(spark):
    duck = duckdb.connect()
    for t in ("clicks", "clients"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(duck.execute(queries.oracle_sql()["op12_retention"]).fetchall())
    assert want and result(queries.op12_retention(spark, SF)) == want
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert result(queries.op12_retention(spark, SF)) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_retention_joins_buckets_without_a_shuffle_and_slices_a_hot_client(spark):
    clicks, clients = shop(random.Random(5), 6000, hot=0.8)
    c, who = spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(clients, CLIENTS)
    tables = retention.write_buckets(c, who, retention.micros(c, "arrived_at"), 1_709_251_200_000_000)
    plan = retention.cells(spark, tables, 3)._jdf.queryExecution().executedPlan().toString()
    below = plan[: plan.find("AdaptiveSparkPlan isFinalPlan=false", 10)] if plan.count("AdaptiveSparkPlan") > 1 else plan
    assert below.count("SortMergeJoin") == 2 and below.count("Bucketed: true") == 3
    shuffles = [x for x in below.split("\n") if "Exchange" in x]
    assert shuffles and all("cohort" in x for x in shuffles) and below.rfind("Exchange") < below.find("SortMergeJoin")
    slices = {r[0]: r[1] for r in spark.table(tables.clicks[0]).where("client_id = 7").groupBy("slice").count().collect()}
    assert len(slices) > 8 and max(slices.values()) < 400
    tables.drop(spark)
    assert not [t for t in spark.catalog.listTables() if t.name in {name for name, _ in tables}]


# Whitening


def brute_whitening(rows, most=4):
    x = {i: np.floor(256 * np.asarray(v, np.float64)).astype(np.int64) for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return x, n, sums, e, v[:, :most]


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(700, 12)) * np.linspace(1, 3, 12)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)] + [(1000 + i, [float(c) for c in base[5]]) for i in range(300)]
    odd = [(2000, None), (2001, [1.0] * 11 + [None]), (2002, [float("nan")] + [0.0] * 11), (2003, [float("inf")] + [0.0] * 11), (2004, [])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").repartition(23)
    x, n, sums, e, v = brute_whitening(rows)
    got = whitening.op13(df).collect()
    assert len(got) == 4 * len(rows)
    sign = {}
    for r in got:
        k = r["component"] - 1
        y = (x[r["vec_id"]] - sums / n) @ v[:, k] / np.sqrt(e[k])
        sign.setdefault(k, np.sign(y * r["whitened"]))
        assert abs(y * sign[k] - r["whitened"]) < 1e-9
        assert r["n"] == n and r["deviation"] == int(((n * x[r["vec_id"]] - sums) ** 2).sum())
        assert abs(r["explained"] - e[k] / e.sum()) < 1e-12 and r["identity_error"] < 1e-9


def test_whitening_merges_are_lossless(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-500, 500, size=(901, 9)) * np.array([1, 1, 1, 1, 1, 1, 1, 1, 0]) + np.arange(9) * 10_000
    parts = [whitening.Summary.of(p) for p in np.split(x, [1, 3, 200, 650])]
    out = parts[0]
    for p in parts[1:]:
        out = out.merged(p)
    centred = x - x.mean(0)
    assert out.n == 901 and (out.sums == x.sum(0)).all() and len(out.r) == 9
    assert np.allclose(out.r.T @ out.r, centred.T @ centred, rtol=1e-12, atol=1e-6)


def test_whitening_of_few_rows_other_dimensions_and_none(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert whitening.op13(spark.createDataFrame([], kind)).collect() == []
    one = whitening.op13(spark.createDataFrame([(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.5, 0.25])], kind)).collect()
    assert len(one) == 6 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in one)
    rows = [(i, [i / 8, 0.0, (i % 3) / 4]) for i in range(9)] + [(100 + i, [i / 4]) for i in range(5)]
    got = whitening.op13(spark.createDataFrame(rows, kind)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["vec_id"]].append(r)
    assert all(len(by[i]) == 3 and by[i][0]["n"] == 9 for i in range(9)) and all(len(by[100 + i]) == 1 and by[100 + i][0]["n"] == 5 for i in range(5))
    assert all((r["whitened"] is None) == (r["component"] == 3) for i in range(9) for r in by[i])
    assert abs(sum(r["explained"] for r in by[0]) - 1) < 1e-12 and all(r["identity_error"] < 1e-12 for r in got)
    large = whitening.op13(spark.createDataFrame([(1, [3e7, 0.0]), (2, [-3e7, 1.0]), (3, [1.0, 2.0])], kind)).collect()
    assert {r["vec_id"]: r["deviation"] is None for r in large} == {1: True, 2: True, 3: False}


def test_nothing_is_left_behind(spark, tmp_path):
    import os

    where = new_path(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    before = set(os.listdir(where))
    whitening.op13(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()
    assert set(os.listdir(where)) == before
