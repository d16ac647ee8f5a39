"""Snapshot tables under concurrent writers and readers, logs that keep no state, and the live search against its batch form."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from reelquery.operators import turns
from reelquery.sources import sinks, snapshots
from reelquery.streaming import logs, machine

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ids(df, name="id"):
    return sorted(r[name] for r in df.select(name).collect())


def test_readers_never_fail_while_a_writer_replaces(spark, tmp_path):
    table = snapshots.Table(spark, f"{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(spark.range(10))
    wrong, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                n = snapshots.Table(spark, f"{tmp_path}/t").read().count()
                if n % 10:
                    wrong.append(n)
            except Exception as e:  # noqa: BLE001
                wrong.append(e)

    readers = [threading.Thread(target=read) for _ in range(2)]
    for r in readers:
        r.start()
    for k in range(2, 9):
        assert table.replace(spark.range(10 * k)) == k
    stop.set()
    for r in readers:
        r.join()
    assert not wrong and table.read().count() == 80 and table.read(3).count() == 30
    assert table.vacuum(keep=1, older_than=-1) == 7 and table.versions() == [8] and table.read().count() == 80


def test_concurrent_writers_both_land(spark, tmp_path):
    path, failed = f"{tmp_path}/t", []

    def write(k):
        try:
            for i in range(6):
                snapshots.Table(spark, path).append(spark.range(100 * k + i, 100 * k + i + 1), f"s{k}", i)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    writers = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    table = snapshots.Table(spark, path)
    assert not failed and ids(table.read()) == sorted(100 * k + i for k in range(3) for i in range(6))
    assert table.version() > 18 and len(table.manifest()["parts"]) < 2 * snapshots.FAN and not [p for p in (tmp_path / "t" / "_versions").rglob(".*") if p.is_dir()]
    before = table.version()
    table.append(spark.range(1), "s0", 5)  # a batch that runs again
    assert table.version() == before


def test_new_keys_of_concurrent_writers_come_once(spark, tmp_path):
    path = f"{tmp_path}/t"

    def write(k):
        for i in range(4):
            snapshots.Table(spark, path).append_new(spark.range(i * 5, i * 5 + 10).select(F.col("id"), F.lit(k).alias("w")), "id", f"s{k}", i)

    writers = [threading.Thread(target=write, args=(k,)) for k in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert ids(snapshots.Table(spark, path).read()) == list(range(25))


def test_new_keys_null_and_text_and_lateness(spark, tmp_path):
    table = snapshots.Table(spark, f"{tmp_path}/t")
    table.append_new(spark.createDataFrame([("b", 1), (None, 2), ("é", 3), ("b", 1)], "k string, at bigint"), "k", "s", 0)
    table.append_new(spark.createDataFrame([("b", 5), (None, 6), ("a", 7)], "k string, at bigint"), "k", "s", 1)
    table.append_new(spark.createDataFrame([], "k string, at bigint"), "k", "s", 2)
    assert sorted(map(str, (r["k"] for r in table.read().collect()))) == ["None", "a", "b", "é"]
    old = snapshots.Table(spark, f"{tmp_path}/u")
    for n, (k, at) in enumerate([(1, 0), (1, 5), (1, 100)]):
        old.append_new(spark.createDataFrame([(k, at)], "k bigint, at bigint"), "k", "s", n, "at", 50)
    assert sorted(r["at"] for r in old.read().collect()) == [0, 100]  # parts that are older than promised aren't looked at


def test_upserts_settle_in_levels(spark, tmp_path):
    rng = random.Random(2)
    table, want = snapshots.Table(spark, f"{tmp_path}/t"), {}
    for n in range(20):
        rows = [(rng.choice([None, *range(12)]), rng.randrange(30), f"{n}.{i}") for i in range(9)]
        table.upsert(spark.createDataFrame([r for r in rows if r[1] is not None], "k int, at int, v string"), "k", "at", "s", n)
        best = {}
        for k, at, _ in rows:
            best[k] = max(best.get(k, -1), at)
        for k, at in best.items():
            if at >= want.get(k, (-1,))[0]:
                want[k] = at, {v for kk, a, v in rows if (kk, a) == (k, at)}
        assert len(table.manifest()["parts"]) < 2 * snapshots.FAN
    got = {r["k"]: (r["at"], r["v"]) for r in table.read().collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] in want[k][1] for k in want)
    assert [p["level"] for p in table.manifest()["parts"]] == [1, 1, 0, 0, 0, 0]
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(1, 1, "")], "k int, at int, v string"), "v", "at")


def test_append_keeps_no_state_and_each_key_once(spark, tmp_path):
    path, out, state = (f"{tmp_path}/{x}" for x in ("log", "out", "state"))
    rows = spark.range(200).withColumn("v", F.col("id") * 2)
    for k in range(4):
        sinks.write_jsonl(rows.where(F.col("id") < 50 * (k + 1)).repartition(3), path, "append")
        q = logs.append(logs.log_stream(spark, path, "id bigint, v bigint", 1), out, state, key="id")
        q.awaitTermination()
        assert all(not p["stateOperators"] for p in q.recentProgress)
    got = logs.appended(spark, out)
    assert ids(got) == list(range(200)) and got.where("v <> 2 * id").count() == 0
    assert len(snapshots.Table(spark, out).manifest()["parts"]) < 2 * snapshots.FAN
    plain = f"{tmp_path}/plain"
    for _ in range(2):
        logs.append(logs.log_stream(spark, path, "id bigint, v bigint"), plain, f"{tmp_path}/state2").awaitTermination()
    assert logs.appended(spark, plain).count() == 500


def test_watch_reports_each_batch(spark, tmp_path):
    path, out, report = (f"{tmp_path}/{x}" for x in ("log", "out", "report"))
    for k in range(3):
        sinks.write_jsonl(spark.createDataFrame([(1, k, 10 + k), (k, 5, 1)], "key bigint, at bigint, rank bigint").coalesce(1), path, "append")
        logs.watch(logs.log_stream(spark, path, "key bigint, at bigint, rank bigint"), out, f"{tmp_path}/state", "key", "at", [F.count(F.lit(1)).alias("n"), F.sum("rank").alias("s")], report).awaitTermination()
    assert sorted(map(tuple, logs.appended(spark, report).collect())) == [(0, 2, 11), (1, 2, 2), (2, 3, 3)]


TURN = "idx bigint, turn int, query string, answer string, instruction string, retrieved string, truth string, at_ms bigint"


def sessions(rng, n, most):
    rows = []
    for i in range(n):
        for t in range(1, rng.randrange(1, most + 3)):
            if rng.random() < 0.93:
                rows.append((i, t, None if i == 3 else f"q{i}", rng.choice(["matched", "not_matched", "not_matched", "unknown", None]), rng.choice(["", None, f"look {t}"]), rng.choice(["a", "b", None]), "a", 1_700_000_000_000 + 1000 * t + i))
    rows += rng.sample(rows, len(rows) // 4) + [(None, 1, "q", "matched", "", "a", "a", 1), (1, None, "q", "matched", "", "a", "a", 1), (1, 1, "q1", "matched", "", "a", "a", None), (5, -1, "q", "x", "", "", "", 5)]
    return rows


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield
    spark.conf.set(name, before)


def run_search(spark, tmp_path, batches, **how):
    path = tmp_path / "log"
    for part in batches:
        sinks.write_jsonl(spark.createDataFrame(part, TURN).coalesce(1), str(path), "append")
        said = logs.log_stream(spark, str(path), TURN, 1).withColumn("at", F.timestamp_millis("at_ms"))
        q = logs.append(machine.search(said, **how), str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination()
    return logs.appended(spark, str(tmp_path / "out")), q


def test_live_search_equals_the_batch_form_after_restarts(spark, tmp_path, rocks):
    rng = random.Random(8)
    rows = sessions(rng, 40, 5)
    rows = [r for i, r in enumerate(rows) if r[:2] not in {x[:2] for x in rows[:i]} or r in rows[:i]]
    shuffled = rng.sample(rows, len(rows))
    got, _ = run_search(spark, tmp_path, [shuffled[:60], shuffled[60:90], shuffled[90:]], max_turns=5, idle="1000 days", late="1000 days")
    good = spark.createDataFrame([r for r in rows if r[0] is not None and r[1] is not None and r[-1] is not None], TURN)
    want = turns.search_turns(good, 5)
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    states = {r["state"] for r in want.collect()}
    assert states == {"active", "matched", "max_turn"}


def test_live_search_drops_what_is_idle(spark, tmp_path, rocks):
    t = lambda i, n, answer, s: (i, n, f"q{i}", answer, "more", "a", "a", 1_700_000_000_000 + 1000 * s)
    batches = [[t(1, 1, "not_matched", 0), t(2, 1, "matched", 0)], [t(3, 1, "matched", 500)], [t(4, 1, "matched", 1000)], [t(5, 1, "matched", 1500)]]
    got, q = run_search(spark, tmp_path, batches, max_turns=3, idle="60 seconds", late="10 seconds")
    found = sorted((r["idx"], r["turn"], r["state"], r["search_query"]) for r in got.collect())
    assert found == [(1, 1, "active", "q1"), (1, 2, "expired", "q1\nmore"), (2, 1, "matched", "q2"), (3, 1, "matched", "q3"), (4, 1, "matched", "q4"), (5, 1, "matched", "q5")]
    assert q.recentProgress[-1]["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] >= 0
