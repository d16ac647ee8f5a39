"""Lookups, merges, order, validation, balancing and log queries over `events`, `labels`, `documents` and `embeddings`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.operators import balance, lookups, merge, order, validate
from reelquery.plans.registry import Tables, query

_M = "WITH m AS (SELECT 'k' || (event_id * 7) % 400 AS key, event_id AS ord, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'p' || event_id END AS pos, event_type AS kind FROM events), r AS (SELECT event_id AS id, 'k' || event_id % 450 AS key FROM events)"


def _meta(t: Tables) -> DataFrame:
    return t.events.selectExpr("concat('k', (event_id * 7) % 400) AS key", "event_id AS ord", "CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('p', event_id) END AS pos", "event_type AS kind")


def _rows(t: Tables) -> DataFrame:
    return t.events.selectExpr("event_id AS id", "concat('k', event_id % 450) AS key")


@query(_M + " SELECT r.id, f.pos, f.kind FROM r JOIN (SELECT key, arg_min(pos, ord) AS pos, arg_min(kind, ord) AS kind FROM m GROUP BY 1) f USING (key)")
def lookup_first_wins(t: Tables) -> DataFrame:
    return lookups.by_text(_rows(t), _meta(t), "key", "ord", "first").select("id", "pos", "kind")


@query(_M + " SELECT r.id, f.pos, f.kind FROM r JOIN (SELECT key, arg_max(pos, ord) AS pos, arg_max(kind, ord) AS kind FROM m GROUP BY 1) f USING (key)")
def lookup_last_wins(t: Tables) -> DataFrame:
    return lookups.by_text(_rows(t), _meta(t), "key", "ord", "last").select("id", "pos", "kind")


@query(_M + " SELECT key, arg_max(pos, ord) FILTER (pos <> '') AS pos, max(ord) AS ord FROM m GROUP BY 1")
def lookup_last_filled(t: Tables) -> DataFrame:
    return lookups.last_filled(_meta(t).withColumn("o", F.col("ord")), "key", "o", ["pos"], ["ord"])


@query(_M + ", f AS (SELECT key, arg_min(kind, ord) AS kind FROM m GROUP BY 1) SELECT r.id, coalesce(a.kind, b.kind) AS kind FROM r LEFT JOIN f a ON a.key = r.key LEFT JOIN f b ON b.key = 'k' || r.id % 50")
def lookup_fallback(t: Tables) -> DataFrame:
    one = order.one_per_key(_meta(t), ["key"], "ord").select("key", "kind")
    rows = lookups.with_fallback(_rows(t), one, [F.col("key"), F.concat(F.lit("k"), F.col("id") % 50)], "key", "kind", "found")
    return rows.select("id", F.col("found").alias("kind"))


_P = "WITH p AS (SELECT '/d' || event_id % 3 || '/v' || event_id % 200 || CASE event_id % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.mkv' WHEN 2 THEN '.webm' ELSE '.txt' END AS path, event_id AS ord FROM events)"


def _paths(t: Tables) -> DataFrame:
    return t.events.selectExpr("concat('/d', event_id % 3, '/v', event_id % 200, CASE event_id % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.mkv' WHEN 2 THEN '.webm' ELSE '.txt' END) AS path", "event_id AS ord")


@query(_P + ", k AS (SELECT unnest([path, regexp_extract(path, '[^/]*$'), regexp_extract(path, '([^/]*)\\.[^.]*$', 1)]) AS key, ord FROM p) SELECT key, max(ord) AS value FROM k GROUP BY 1")
def path_index(t: Tables) -> DataFrame:
    return lookups.path_index(_paths(t), "path", "ord", "ord")


@query(_P + ", e AS (SELECT *, regexp_extract(path, '([^/]*)\\.[^.]*$', 1) AS stem, list_position(['.mkv', '.mp4', '.webm'], regexp_extract(path, '(\\.[^.]*)$', 1)) AS r FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY r, ord) AS n FROM e WHERE r > 0) SELECT stem, path FROM b WHERE n = 1")
def best_extension(t: Tables) -> DataFrame:
    return lookups.best_extension(_paths(t), "path", "ord", [".mkv", ".mp4", ".webm"])


@query("""WITH r AS (SELECT event_id AS ord, 'q' || event_id % 300 AS query, CASE WHEN (event_id % 300) % 2 = 0 THEN 'p' || event_id % 4 ELSE '' END AS pos FROM events), m AS (SELECT event_id AS ord, 'q' || (event_id * 3) % 350 AS query, CASE WHEN event_id % 2 = 0 THEN 'p' || event_id % 4 ELSE 'p' END AS pos FROM events),
a AS (SELECT *, row_number() OVER (PARTITION BY query, pos ORDER BY ord) AS n FROM r WHERE pos <> ''), b AS (SELECT *, row_number() OVER (PARTITION BY query, pos ORDER BY ord) AS n FROM m), c AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ord) AS n FROM r WHERE pos = ''), d AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ord) AS k FROM m)
SELECT a.query, a.ord, b.ord AS meta_ord FROM a JOIN b USING (query, pos, n) UNION ALL SELECT c.query, c.ord, d.ord FROM c JOIN d ON c.query = d.query AND c.n = d.k""")
def bag_matching(t: Tables) -> DataFrame:
    r = t.events.selectExpr("event_id AS ord", "concat('q', event_id % 300) AS query", "CASE WHEN (event_id % 300) % 2 = 0 THEN concat('p', event_id % 4) ELSE '' END AS pos")
    m = t.events.selectExpr("event_id AS ord", "concat('q', (event_id * 3) % 350) AS query", "CASE WHEN event_id % 2 = 0 THEN concat('p', event_id % 4) ELSE 'p' END AS pos")
    return lookups.bag_match(r, m, "query", "pos", "ord")


_MIXED = """WITH RECURSIVE r AS (SELECT ord, CASE WHEN ord % 97 = 0 THEN '' ELSE 'q' || ord // 12 END AS query, CASE WHEN ord % 5 < 2 THEN '' ELSE 'p' || ord % 3 END AS pos FROM (SELECT event_id AS ord FROM events)),
m AS (SELECT query, list(struct_pack(o := ord, p := pos) ORDER BY ord) AS items FROM (SELECT event_id AS ord, 'q' || event_id // 11 AS query, CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'p' || event_id % 4 END AS pos FROM events) GROUP BY 1),
n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ord) AS k FROM r WHERE query <> ''),
f AS (SELECT query, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS ord, NULL::BIGINT AS meta_ord FROM m
  UNION ALL SELECT query, k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, ord, pick FROM (SELECT f.query, n.k, f.used, n.ord, list_filter(m.items, lambda i: (n.pos = '' OR coalesce(i.p, '') = n.pos) AND NOT list_contains(f.used, i.o))[1].o AS pick FROM f JOIN n ON n.query = f.query AND n.k = f.k + 1 JOIN m ON m.query = f.query)),
took AS (SELECT query, ord, meta_ord FROM f WHERE meta_ord IS NOT NULL)"""


def _mixed(t: Tables) -> tuple[DataFrame, DataFrame]:
    r = t.events.selectExpr("event_id AS ord", "CASE WHEN event_id % 97 = 0 THEN '' ELSE concat('q', event_id div 12) END AS query", "CASE WHEN event_id % 5 < 2 THEN '' ELSE concat('p', event_id % 3) END AS pos")
    return r, t.events.selectExpr("event_id AS ord", "concat('q', event_id div 11) AS query", "CASE WHEN event_id % 10 = 0 THEN NULL ELSE concat('p', event_id % 4) END AS pos")


@query(_MIXED + " SELECT * FROM took")
def bag_matching_mixed(t: Tables) -> DataFrame:
    """Requests with and without a pos in one query share its rows: who comes first decides."""
    return lookups.bag_match(*_mixed(t), "query", "pos", "ord")


@query(_MIXED + " SELECT CASE WHEN query = '' THEN 'query_empty' WHEN pos = '' THEN 'query_not_found_in_meta' ELSE 'query_pair_not_found_in_meta' END AS reason, count(*) AS n FROM r WHERE ord NOT IN (SELECT ord FROM took) GROUP BY 1")
def bag_matching_skips(t: Tables) -> DataFrame:
    r, m = _mixed(t)
    return lookups.bag_skips(r, lookups.bag_match(r, m, "query", "pos", "ord"), "query", "pos", "ord")


@query("WITH a AS (SELECT * FROM events WHERE event_id % 5 < 3) SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM a)")
def resume_anti_join(t: Tables) -> DataFrame:
    return lookups.not_done(t.events, t.events.where("event_id % 5 < 3"), "event_id").select("event_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) OR doc_id IN (SELECT item_id FROM benchmark)")
def semi_join_keep(t: Tables) -> DataFrame:
    return lookups.members(t.documents, t.labels.where("quality = 1").select("doc_id"), t.benchmark.select(F.col("item_id").alias("doc_id")), key="doc_id").select("doc_id")


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels)")
def missing_media(t: Tables) -> DataFrame:
    return lookups.missing(t.events, t.labels.select(F.col("doc_id").alias("user_id")), "user_id")


@query("SELECT e.event_id, coalesce(k.v, e.value) AS value, k.v IS NOT NULL AS was_reused FROM events e LEFT JOIN (SELECT event_id * 2 AS event_id, value + 1 AS v FROM events) k USING (event_id)")
def reuse_lookup(t: Tables) -> DataFrame:
    known = t.events.selectExpr("event_id * 2 AS event_id", "value + 1 AS value")
    return lookups.reused(t.events.select("event_id", "value"), known, "event_id", "value")


@query("""WITH b AS (SELECT event_id AS doc, value AS v, event_id AS row FROM events WHERE event_id % 3 > 0), p AS (SELECT event_id AS doc, value * 2 AS v FROM events WHERE event_id % 4 = 0)
SELECT b.doc, coalesce(p.v, b.v) AS v, b.row FROM b LEFT JOIN p ON b.doc = p.doc UNION ALL SELECT p.doc, p.v, (SELECT max(row) FROM b) + row_number() OVER (ORDER BY p.doc) FROM p WHERE p.doc NOT IN (SELECT doc FROM b)""")
def upsert_patch(t: Tables) -> DataFrame:
    b = t.events.where("event_id % 3 > 0").selectExpr("event_id AS doc", "value AS v", "event_id AS row")
    return lookups.upsert(b, t.events.where("event_id % 4 = 0").selectExpr("event_id AS doc", "value * 2 AS v"), "doc", "v", "row")


_U = "WITH m AS (SELECT user_id AS k, min(event_id) AS o FROM events WHERE event_id % 3 = 0 GROUP BY 1), x AS (SELECT user_id AS k, event_id AS o FROM events WHERE event_id % 3 = 1), r AS (SELECT DISTINCT user_id AS k FROM events WHERE event_id % 2 = 0)"


@query(_U + " SELECT k, o FROM m UNION ALL SELECT k, min(o) FROM x WHERE k IN (SELECT k FROM r) AND k NOT IN (SELECT k FROM m) GROUP BY 1")
def append_if_absent(t: Tables) -> DataFrame:
    e = t.events
    m = e.where("event_id % 3 = 0").groupBy(F.col("user_id").alias("k")).agg(F.min("event_id").alias("o"))
    return lookups.append_absent(m, e.where("event_id % 3 = 1").selectExpr("user_id AS k", "event_id AS o"), e.where("event_id % 2 = 0").selectExpr("user_id AS k"), "k", "o")


@query("WITH i AS (SELECT event_id * 2 AS row, 'd' || event_id AS doc FROM events WHERE event_id % 3 = 0) SELECT n.row, coalesce(i.doc, '') AS doc FROM range((SELECT greatest(count(*), max(row) + 1) FROM i)) n(row) LEFT JOIN i USING (row)")
def rows_with_gaps(t: Tables) -> DataFrame:
    return lookups.by_row(t.events.where("event_id % 3 = 0").selectExpr("event_id * 2 AS row", "concat('d', event_id) AS doc"), "doc", "row")


_LOG = "l AS (SELECT event_id AS ord, CASE WHEN event_id % 4 > 0 THEN event_id % 700 END AS idx, CASE WHEN event_id % 8 = 0 THEN ' ' ELSE 'q' || event_id % 90 END AS qid, value FROM events), k AS (SELECT *, CASE WHEN idx IS NOT NULL THEN 'idx:' || idx WHEN trim(qid) <> '' THEN 'qid:' || trim(qid) ELSE 'row:' || ord END AS key FROM l)"


def _log(t: Tables) -> DataFrame:
    return t.events.selectExpr("event_id AS ord", "CASE WHEN event_id % 4 > 0 THEN event_id % 700 END AS idx", "CASE WHEN event_id % 8 = 0 THEN ' ' ELSE concat('q', event_id % 90) END AS qid", "value")


@query("WITH " + _LOG + " SELECT key AS log_key, max(ord) AS ord, min(ord) AS first_seen FROM k GROUP BY 1")
def log_latest(t: Tables) -> DataFrame:
    return merge.latest_log(_log(t), "idx", "qid", "ord").select("log_key", "ord", "first_seen")


@query("WITH " + _LOG + ", x AS (SELECT CASE WHEN idx IS NOT NULL THEN 'idx:' || idx WHEN trim(qid) <> '' THEN 'qid:' || trim(qid) ELSE 'qid:' END AS key, ord FROM l) SELECT key AS log_key, max(ord) AS ord FROM x GROUP BY 1")
def log_latest_collapsed(t: Tables) -> DataFrame:
    return merge.latest_log(_log(t), "idx", "qid", "ord", collapse=True).select("log_key", "ord")


@query("WITH " + _LOG + " SELECT idx, min(ord) AS ord FROM k WHERE idx IS NOT NULL GROUP BY 1 UNION ALL SELECT NULL, ord FROM k WHERE idx IS NULL")
def merge_first_wins(t: Tables) -> DataFrame:
    return merge.first_wins(_log(t), "idx", "ord").select("idx", "ord")


@query("WITH " + _LOG + " SELECT idx, max(ord) AS ord, row_number() OVER (ORDER BY idx) AS place FROM k WHERE idx IS NOT NULL GROUP BY idx UNION ALL SELECT NULL, ord, (SELECT count(DISTINCT idx) FROM k) + row_number() OVER (ORDER BY ord) FROM k WHERE idx IS NULL")
def merge_last_wins(t: Tables) -> DataFrame:
    out = merge.last_wins(_log(t), "idx", "ord")
    return order.numbered(out, ["place"], "at", start=1).select("idx", "ord", F.col("at").alias("place"))


@query("WITH " + _LOG + ", s AS (SELECT *, (ord % 3 = 0)::INT AS src FROM k), n AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN key LIKE 'row:%' THEN key || '/' || src ELSE key END ORDER BY src DESC, ord DESC) AS rn FROM s) SELECT idx, qid, ord FROM n WHERE rn = 1")
def merge_override(t: Tables) -> DataFrame:
    log = _log(t)
    return merge.override(log.where("ord % 3 <> 0"), log.where("ord % 3 = 0"), "idx", "qid", "ord").select("idx", "qid", "ord")


@query("""WITH o AS (SELECT event_id AS ord, user_id AS doc, event_type AS error FROM events), r AS (SELECT DISTINCT user_id AS doc FROM events WHERE event_id % 11 = 0), u AS (SELECT 0 AS s, * FROM o WHERE ord % 2 = 0 AND doc NOT IN (SELECT doc FROM r) UNION ALL SELECT 1, * FROM o WHERE ord % 2 = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY doc, error ORDER BY s, ord) AS rn FROM u) SELECT doc, error, ord FROM n WHERE rn = 1""")
def merge_failures(t: Tables) -> DataFrame:
    o = t.events.selectExpr("event_id AS ord", "user_id AS doc", "event_type AS error")
    return merge.failures(o.where("ord % 2 = 0"), o.where("ord % 11 = 0"), o.where("ord % 2 = 1"), "doc", "error", "ord").select("doc", "error", "ord")


@query("WITH " + _LOG + ", b AS (SELECT *, ord % 10 = 0 AS bad FROM k) SELECT count(*) AS read, count(*) FILTER (bad) AS bad, count(DISTINCT idx) FILTER (NOT bad) AS unique, count(idx) FILTER (NOT bad) - count(DISTINCT idx) FILTER (NOT bad) AS dropped, count(DISTINCT idx) FILTER (NOT bad) + count(*) FILTER (NOT bad AND idx IS NULL) AS written FROM b".replace(" AS unique", ' AS "unique"'))
def merge_counts(t: Tables) -> DataFrame:
    return merge.merge_counts(_log(t).withColumn("bad", F.col("ord") % 10 == 0), "idx", "bad")


@query("SELECT vec_id AS doc, row_number() OVER (ORDER BY vec_id % 3, vec_id) - 1 AS row FROM embeddings")
def merge_matrices(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec"), F.col("vec_id").alias("row"))
    return merge.merge_matrices(*[e.where(f"doc % 3 = {k}") for k in range(3)]).select("doc", "row")


@query("SELECT event_id, user_id, NULL AS doc_id, 0 AS part FROM events UNION ALL SELECT NULL, NULL, doc_id, 1 FROM labels")
def union_datasets(t: Tables) -> DataFrame:
    return merge.union_all(t.events.select("event_id", "user_id"), t.labels.select("doc_id")).select("event_id", "user_id", "doc_id", "part")


@query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts NULLS FIRST, event_id NULLS FIRST) - 1 AS i FROM events) SELECT event_id, i % 5 AS shard FROM r")
def round_robin_shards(t: Tables) -> DataFrame:
    return order.shard(t.events.select("event_id", "ts"), ["ts", "event_id"], 5).select("event_id", "shard")


@query("SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS problem_id FROM events")
def contiguous_ids(t: Tables) -> DataFrame:
    return order.numbered(t.events.select("event_id", "value"), ["value", "event_id"], "problem_id").select("event_id", "problem_id")


@query("""WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) SELECT event_id, user_id FROM n WHERE rn <= 3""")
def capped_rows(t: Tables) -> DataFrame:
    return order.capped_per_group(t.events, "user_id", "event_id", 3).select("event_id", "user_id")


@query("""WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), c AS (SELECT * FROM n WHERE rn <= 2),
s AS (SELECT event_id, sum((rn = 1)::INT) OVER (ORDER BY event_id) AS seen, sum((rn = 2)::INT) OVER (ORDER BY event_id) AS filled FROM c), p AS (SELECT min(event_id) AS p FROM s WHERE seen >= 5 AND seen = filled) SELECT event_id, user_id FROM c, p WHERE p IS NULL OR event_id <= p""")
def capped_rows_until(t: Tables) -> DataFrame:
    return order.capped_per_group(t.events, "user_id", "event_id", 2, groups=5).select("event_id", "user_id")


@query("SELECT text_md5, min(doc_id) AS first_seen FROM (SELECT md5(text) AS text_md5, doc_id FROM documents) GROUP BY 1")
def distinct_in_order(t: Tables) -> DataFrame:
    return order.distinct_in_order(t.documents.select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "doc_id"), "text_md5", "doc_id")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1")
def most_common(t: Tables) -> DataFrame:
    return order.common_first(t.events, "event_type", "event_id")


@query("SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM documents WHERE doc_id % 2 = 0 OR doc_id % 2 = 1) WHERE coalesce(before, 0) < 200000")
def byte_budget_dump(t: Tables) -> DataFrame:
    return validate.within_bytes(t.documents, "n_chars", "doc_id", 200_000).select("doc_id")


@query("""SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'no_text' WHEN n_chars < 500 THEN 'short' WHEN lang <> 'en' THEN 'language' ELSE 'ok' END AS reason, count(*) AS n FROM documents GROUP BY 1""")
def skip_counts(t: Tables) -> DataFrame:
    return validate.skip_counts(t.documents, [("no_text", F.col("text").isNull() | (F.trim("text") == "")), ("short", F.col("n_chars") < 500), ("language", F.col("lang") != "en")])


@query("""SELECT count(*) AS total, count(*) FILTER (n_chars >= 500 AND lang = 'en') AS valid, count(*) FILTER (n_chars < 500) AS short, count(*) FILTER (n_chars >= 500 AND lang <> 'en') AS language FROM documents""")
def loader_stats(t: Tables) -> DataFrame:
    return validate.loader_stats(t.documents, [("short", F.col("n_chars") < 500), ("language", F.col("lang") != "en")])


@query("WITH q AS (SELECT event_id AS line, (event_id * 3) % 800 || '_fig' AS qid FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY line) AS rn FROM q) SELECT line, CASE WHEN rn > 1 THEN qid || '_' || line ELSE qid END AS qid FROM n")
def unique_query_ids(t: Tables) -> DataFrame:
    return validate.unique_qids(t.events.selectExpr("event_id AS line", "concat((event_id * 3) % 800, '_fig') AS qid"), "qid", "line")


_Q = "q AS (SELECT event_id AS id, CASE WHEN event_id % 6 = 0 THEN '  ' ELSE event_type END AS query, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'd' || (event_id % 900) END AS pos FROM events)"


@query("WITH " + _Q + " SELECT id FROM q WHERE trim(query) <> '' AND pos IN (SELECT 'd' || doc_id FROM labels)")
def usable_queries(t: Tables) -> DataFrame:
    q = t.events.selectExpr("event_id AS id", "CASE WHEN event_id % 6 = 0 THEN '  ' ELSE event_type END AS query", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('d', event_id % 900) END AS pos")
    return validate.usable_queries(q, t.labels.select(F.concat(F.lit("d"), "doc_id").alias("doc")), "query", "pos", "doc").select("id")


@query("SELECT event_id AS id, coalesce(event_type = 'click' OR (event_id % 3 = 0), false) AS negative, event_id % 4 <> 0 AS kept, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN '7' ELSE 'b' END AS chosen FROM events")
def sample_predicates(t: Tables) -> DataFrame:
    e = t.events
    gold = F.when(F.col("event_type") == "click", " NEG ").otherwise("pos")
    response = F.when(F.col("event_id") % 3 == 0, "<answer>not_matched</answer>").otherwise("x")
    reason = F.when(F.col("event_id") % 4 == 0, " Length").when(F.col("event_id") % 4 == 1, "").otherwise("stop")
    rows = e.select(F.col("event_id").alias("id"), gold.alias("gold"), response.alias("response"), reason.alias("reason"))
    keep = validate.finished(rows, "reason", "length, error").select("id", F.lit(True).alias("kept"))
    first = validate.first_reason([("a", F.col("id") % 3 == 0), ("7", F.col("id") % 3 == 1)])
    out = rows.join(keep, "id", "left")
    return out.select("id", validate.is_negative(F.col("response"), F.col("gold")).alias("negative"), F.coalesce("kept", F.lit(False)).alias("kept"), F.when(first == "ok", "b").otherwise(first).alias("chosen"))




@query("WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY md5('5|' || doc_id), doc_id) - 1 AS pl FROM labels) SELECT doc_id, CASE WHEN pl < 60 THEN 'test' ELSE 'train' END AS split FROM h")
def split_train_test(t: Tables) -> DataFrame:
    return balance.split(t.labels.select("doc_id"), "doc_id", 60, seed=5)


@query("WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY md5('6|' || doc_id), doc_id) - 1 AS pl FROM labels) SELECT doc_id, CASE WHEN pl < greatest(1, round_even((SELECT count(*) FROM labels) * 0.2, 0)) THEN 'eval' ELSE 'train' END AS split FROM h")
def split_ratio(t: Tables) -> DataFrame:
    return balance.split_ratio(t.labels.select("doc_id"), "doc_id", 0.2, seed=6)


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 100")
def head_limit(t: Tables) -> DataFrame:
    return balance.head(t.events.select("event_id"), "event_id", 100)


@query("SELECT event_id FROM events ORDER BY md5('2|' || event_id), event_id LIMIT (SELECT greatest(1, round_even(count(*) * 0.05, 0))::BIGINT FROM events)")
def sample_ratio(t: Tables) -> DataFrame:
    return balance.sample_ratio(t.events.select("event_id"), "event_id", 0.05, seed=2)


@query("WITH h AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('1|' || doc_id), doc_id) AS rn FROM labels) SELECT doc_id, toxic::VARCHAR AS label FROM h WHERE rn <= CASE toxic WHEN 1 THEN 20 ELSE 30 END")
def stratified_cap(t: Tables) -> DataFrame:
    rows = t.labels.select("doc_id", F.col("toxic").cast("string").alias("label"))
    return balance.stratified(rows, "label", "doc_id", {"1": 20, "0": 30}, seed=1)


@query("WITH h AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('4|' || doc_id), doc_id) AS rn FROM labels) SELECT doc_id, toxic::VARCHAR AS label FROM h WHERE rn <= (SELECT least(count(*) FILTER (toxic = 1), count(*) FILTER (toxic = 0)) FROM labels)")
def balanced_labels(t: Tables) -> DataFrame:
    rows = t.labels.select("doc_id", F.col("toxic").cast("string").alias("label"))
    return balance.balanced(rows, "label", "doc_id", "1", "0", seed=4)


@query("""WITH c AS (SELECT doc_id FROM labels WHERE quality = 0), n AS (SELECT count(*) FILTER (toxic = 1) AS m, count(*) FILTER (toxic = 0) AS u FROM labels), x AS (SELECT cycle, doc_id, row_number() OVER (ORDER BY cycle, md5('9|' || cycle || '|' || doc_id), doc_id) AS rn FROM range(40) r(cycle), c)
SELECT doc_id, cycle FROM x, n WHERE rn <= greatest(0, u - m)""")
def upsample(t: Tables) -> DataFrame:
    n = t.labels.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    return balance.upsampled(n[0], n[1], t.labels.where("quality = 0").select("doc_id"), "doc_id", 1.0, seed=9).select("doc_id", "cycle")


@query("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () // 8 * 8 AS n FROM labels) SELECT doc_id, ((i // 8 * 2 + r) * 8 + i % 8) * 3 + m AS slot FROM o, range(2) a(r), range(3) b(m) WHERE i < n""")
def repeat_sampler(t: Tables) -> DataFrame:
    return balance.repeated(t.labels.select("doc_id"), "doc_id", 8, 3, 2)


@query("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labels) SELECT doc_id, least(i // greatest(1, n // 7), 6) AS chunk FROM o")
def chunked(t: Tables) -> DataFrame:
    return balance.chunks(t.labels.select("doc_id"), "doc_id", 7)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('3|' || doc_id), doc_id) - 1 AS at FROM labels")
def shuffled(t: Tables) -> DataFrame:
    return balance.shuffled(t.labels.select("doc_id"), "doc_id", seed=3)


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'null' WHEN event_id % 4 = 1 THEN 'x' || event_id ELSE 'y' END AS chosen FROM events")
def presence_chain(t: Tables) -> DataFrame:
    j = F.when(F.col("event_id") % 4 == 0, F.lit('{"a": null, "b": "y"}')).when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"a": "x'), F.col("event_id"), F.lit('", "b": "z"}'))).otherwise(F.lit('{"b": "y"}'))
    return t.events.select("event_id", validate.presence_chain(j, ["a", "b"]).alias("chosen"))
