"""Queries whose SQL says the same in another way, against brute force."""

import unicodedata
from decimal import ROUND_HALF_UP, Decimal

import duckdb

from reelquery.plans import QUERIES

SF = "/root/testdata/sf0.001"


def column(what):
    return [r if len(r) > 1 else r[0] for r in duckdb.sql(f"SELECT {what}").fetchall()]


def test_seconds_text(spark):
    want = {}
    for i in column(f"event_id FROM '{SF}/events.parquet'"):
        x = (Decimal(i), Decimal(i) / 8, Decimal(i % 1000) / 1024)[i % 3]
        text = str(x.quantize(Decimal("0.000001"), ROUND_HALF_UP)).rstrip("0")
        want[i] = text + "0" if text.endswith(".") else text
    got = QUERIES["seconds_text"](spark, SF).collect()
    assert {r["id"]: r["seconds"] if "." in r["seconds"] else r["seconds"] + ".0" for r in got} == want and len(got) == len(want)


def test_judge_response(spark):
    forms = [("", "", None, None, False, "a"), ("matched", "", None, None, True, ""), *[("", "", None, None, False, "")] * 3, ("not_matched", "it differs", 3.5, 9.0, True, "why not")]
    ids = column(f"event_id FROM '{SF}/events.parquet'")
    got = QUERIES["judge_response"](spark, SF).collect()
    assert sorted(r["id"] for r in got) == sorted(ids) and any(i % 6 == 2 for i in ids)
    assert all(tuple(r)[1:] == forms[r["id"] % 6] for r in got)


def test_bad_queries(spark):
    bad = lambda t: len(t.strip()) < 3 or sum(unicodedata.category(c)[0] in "LN" for c in t) < 2
    rows = column(f"doc_id, text FROM '{SF}/documents.parquet'")
    got = QUERIES["bad_queries"](spark, SF).collect()
    assert {r["doc_id"]: r["bad"] for r in got} == {i: bad(t or "") for i, t in rows} and len(got) == len(rows)


def test_round_robin_shards(spark):
    rows = sorted(column(f"ts, event_id FROM '{SF}/events.parquet'"))
    got = QUERIES["round_robin_shards"](spark, SF).collect()
    assert {r["event_id"]: r["shard"] for r in got} == {i: n % 5 for n, (_, i) in enumerate(rows)} and len(got) == len(rows)
