"""Queries over files that they write from the tables: named datasets, large JSON documents, matrices, reports, media listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.functions import temporal
from reelquery.operators import contrastive, order, report
from reelquery.plans.logs import _place
from reelquery.plans.registry import Tables, query
from reelquery.sources import jsonl, loaders, matrix, sinks

#: Rows of an annotation file by name, from a benchmark item (i: its id, t: its text), and what the loader makes of them in SQL: question, answer, media, type.
_NAMED: dict[str, tuple[str, str, str, str, str]] = {
    "DAPO-Math": ("t AS prompt, CAST(i AS STRING) AS solution", "t", "i::VARCHAR", "NULL", "'math'"),
    "VIRL": ("concat('<image> ', t) AS question, concat('so \\\\boxed{', IF(i % 2 = 0, 'Cartoonish', '3.5'), '}') AS answer, IF(i % 3 = 0, array('a.png', 'b.png'), array(concat('./x//', i, '.png'))) AS image", "trim(t)", "CASE WHEN i % 2 = 0 THEN 'Cartoonish' ELSE '3.5' END", "'/m/x/' || i || '.png'", "CASE WHEN i % 2 = 0 THEN 'exact_match' ELSE 'math' END"),
    "ThinkLite-VL-Hard": ("concat(t, '<image>') AS problem, i AS ground_truth, 'math' AS problem_type, concat('../', i, '.jpg') AS image", "trim(t)", "i::VARCHAR", "'/' || i || '.jpg'", "'math'"),
    "VideoR1": ("t AS problem, element_at(array('multiple choice', 'numerical', 'regression'), CAST(1 + i % 3 AS INT)) AS problem_type, array('A. x', 'B. y') AS options, IF(i % 5 = 0, 'none', concat('\\n<answer> ', i, ' </answer>')) AS solution, 'video' AS data_type, 'v.mp4' AS path", "t || CASE WHEN i % 3 = 0 THEN 'Options:' || chr(10) || 'A. x' || chr(10) || 'B. y' || chr(10) ELSE '' END", "i::VARCHAR", "'/m/v.mp4'", "CASE WHEN i % 3 = 0 THEN 'exact_match' ELSE 'math' END"),
    "LongVideoReason": ("t AS problem, 'video' AS data_type, concat('<answer>', i, '</answer>') AS answer, 'l/v.mp4' AS videos", "t", "i::VARCHAR", "'/m/l/v.mp4'", "'exact_match'"),
    "TVBench": ("t AS question, array('x', 'y', CAST(i AS STRING)) AS candidates, CAST(i AS STRING) AS answer, 'v.mp4' AS video, 1.5D AS start, 3D AS end, '/d/action_sequence.json' AS file", "'Question: ' || t || chr(10) || 'Options:' || chr(10) || 'A. x' || chr(10) || 'B. y' || chr(10) || 'C. ' || i || chr(10)", "'C'", "'/m/action_sequence/v.mp4'", "'exact_match'"),
    "STI-Bench": ("t AS Question, map('A', 'x', 'B', CAST(i AS STRING)) AS Candidates, i AS time_start, i + 2 AS time_end, 'B' AS Answer, 'v.mp4' AS Video", "'From ' || i || ' s to ' || (i + 2) || ' s. ' || t || chr(10) || '(A) x' || chr(10) || '(B) ' || i", "'B'", "'/m/v.mp4'", "'exact_match'"),
    "MMR-VBench": ("t AS question, array('(A) x', '', concat('(B) ', i)) AS options, '(B) z' AS correctAnswer, 'v.mp4' AS video", "t || chr(10) || 'Options:' || chr(10) || 'A. x' || chr(10) || 'B. ' || i", "'B'", "'/m/v.mp4'", "'exact_match'"),
    "CG-Bench": ("t AS question, array('x', CAST(i AS STRING)) AS choices, 'B' AS right_answer, concat('u', i) AS video_uid", "t || chr(10) || 'Options:' || chr(10) || 'A. x' || chr(10) || 'B. ' || i", "'B'", "'/m/filtered_videos/u' || i || '.mp4'", "'exact_match'"),
    "Charades-STA": ("t AS description, array(i, i + 1.5D) AS timestamps, 'v.mp4' AS video", "$locate || t || $format", "'[' || i || '.0,' || (i + 1) || '.5]'", "'/m/v.mp4'", "'iou'"),
    "NeXT-GQA": ("t AS question, array('x', 'y') AS options, 'A' AS answer, array(i, i + 2D) AS timestamps, 'v.mp4' AS video", "'Question: ' || t || chr(10) || 'Options:' || chr(10) || 'x' || chr(10) || 'y' || chr(10) || $grounded", "'A'", "'/m/v.mp4'", "'gqa'"),
    "ActivityNet-TVG": ("t AS description, array(i, i + 1.5D) AS timestamps, '/abs/v.mp4' AS video", "$locate || t || $format", "'[' || i || '.0,' || (i + 1) || '.5]'", "'/abs/v.mp4'", "'iou'"),
    "TimeR1": ("t AS sentence, array(i, i + 1.5D) AS timestamp, 'v.mp4' AS video", "$locate || t || $format", "'[' || i || '.0,' || (i + 1) || '.5]'", "'/m/v.mp4'", "'iou'"),
    "Verified-Match-Minimal": ("IF(i % 4 = 0, '', t) AS problem, 'other' AS query, 'matched' AS solution, ' Image ' AS data_type, 'p.npy' AS path", "trim(t)", "'matched'", "'/m/p.npy'", "'exact_match'"),
    "Verified-Search-small": ("IF(i % 4 = 0, CAST(NULL AS STRING), t) AS fig_desc, concat('q', i) AS query, concat(' v', i, ' ') AS video, i AS qid", "CASE WHEN i % 4 = 0 THEN 'q' || i ELSE trim(t) END", "'v' || i", "NULL", "'retrieval'"),
}
_LEFT_OUT = {"VIRL": "i % 3 <> 0", "VideoR1": "i % 3 <> 2 AND i % 5 <> 0", "Verified-Match-Minimal": "i % 4 <> 0 AND trim(t) <> ''", "Verified-Search-small": "i % 4 = 0 OR trim(t) <> ''"}


def _named_sql() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    fixed = {"$locate": text(loaders.LOCATE), "$format": text(loaders.LOCATE_FORMAT), "$grounded": text(loaders.GROUNDED_FORMAT).replace("\n", "' || chr(10) || '")}
    parts = [f"SELECT '{name}' AS source, i, {q} AS question, {a} AS answer, {m} AS media, {k} AS problem_type FROM b WHERE {_LEFT_OUT.get(name, 'true')}" for name, (_, q, a, m, k) in _NAMED.items()]
    sql = "WITH b AS (SELECT item_id AS i, text AS t FROM benchmark) SELECT source, md5(question) AS question, answer, media, problem_type, count(*) AS n FROM (" + " UNION ALL ".join(parts) + ") GROUP BY ALL"
    for k, v in fixed.items():
        sql = sql.replace(k, v)
    return sql


@query(_named_sql())
def named_datasets(t: Tables) -> DataFrame:
    """Each of the named datasets over all benchmark items, loaded and united."""
    b = t.benchmark.selectExpr("item_id AS i", "text AS t")
    rows = loaders.load_all({name: b.selectExpr(*_expressions(made)) for name, (made, *_) in _NAMED.items()}, root="/m")
    return rows.groupBy("source", F.md5(F.col("question").cast("binary")).alias("question"), "answer", "media", "problem_type").agg(F.count(F.lit(1)).alias("n"))


def _expressions(text: str) -> list[str]:
    """The expressions of a select list: cut at commas outside of brackets and quotes."""
    out, depth, quoted = [""], 0, False
    for c in text:
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return out


def _documents(t: Tables, path: str, of) -> str:
    """Writes a JSON document for each thousand events, each in a file of its own."""
    rows = t.events.select("event_id", F.to_json(F.struct("event_id", "event_type", "props", F.array("value", F.lit(1.5)).alias("values")), {"ignoreNullFields": "false"}).alias("line"))
    each = rows.groupBy(F.expr("event_id div 1000").alias("g")).agg(F.sort_array(F.collect_list(F.struct("event_id", "line"))).alias("r"))
    each.select(of(F.transform("r", lambda x: x["line"])).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("SELECT event_id, event_type, props FROM events")
def json_arrays(t: Tables) -> DataFrame:
    """Arrays, read in parallel; strings in them hold commas, quotes and brackets."""
    path = _documents(t, _place(t, "array"), lambda x: F.concat(F.lit("[1, "), F.array_join(x, ",\t"), F.lit(', "x", []]')))
    return jsonl.read_any(t.spark, path, "event_id bigint, event_type string, props string").drop("ord")


@query("SELECT event_id, event_type, props FROM events")
def json_data_objects(t: Tables) -> DataFrame:
    """Objects with an array `data` between other members."""
    path = _documents(t, _place(t, "data"), lambda x: F.concat(F.lit('{"meta": {"data": [{"event_id": -1}]}, "data": ['), F.array_join(x, " , "), F.lit('], "tail": [{"event_id": -2}]}')))
    return jsonl.read_any(t.spark, path, "event_id bigint, event_type string, props string").drop("ord")


@query("SELECT event_id, event_type, value FROM events")
def jsonl_strict(t: Tables) -> DataFrame:
    """Lines of which none is broken, read strictly."""
    path = _place(t, "jsonl")
    sinks.write_jsonl(t.events.select("event_id", "event_type", "value"), path)
    return jsonl.read_jsonl(t.spark, path, "event_id bigint, event_type string, value double", mode="strict").drop("ord")


@query("SELECT 'e,' || vec_id || '\"' AS doc, vec_id AS row FROM embeddings")
def id_map(t: Tables) -> DataFrame:
    """A map of ids to rows as JSON objects, sorted by row."""
    pairs = t.embeddings.select((F.col("vec_id") % 7).alias("g"), F.to_json(F.create_map(F.concat(F.lit("e,"), "vec_id", F.lit('"')), F.col("vec_id"))).alias("x"), F.expr("vec_id div 1000").alias("h"))
    each = pairs.groupBy("g", "h").agg(F.collect_list(F.expr("substring(x, 2, length(x) - 2)")).alias("x"))
    path = _place(t, "ids")
    each.select(F.concat(F.lit("{"), F.array_join("x", ", "), F.lit("}")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return jsonl.id_rows(t.spark, path)


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last FROM embeddings")
def matrix_rows(t: Tables) -> DataFrame:
    """Vectors as .npy files beside their meta data as JSON lines, joined by position; the lengths have to agree."""
    place, meta = _place(t, "matrix"), _place(t, "meta")
    rows = order.numbered(t.embeddings.select("vec_id", "label", "embedding"), ["vec_id"], "row")
    matrix.write_matrix(rows.select("row", F.col("embedding").alias("vec")), place)
    sinks.write_jsonl(rows.select("row", "vec_id", "label"), meta)
    said = jsonl.read_jsonl(t.spark, meta, "row bigint, vec_id bigint, label int").drop("ord")
    both = jsonl.with_meta(jsonl.read_matrix(t.spark, place, said, rows=1000), said, "row")
    return both.select("row", "vec_id", "label", F.round(F.element_at("vec", 1).cast("double"), 6).alias("first"), F.round(F.element_at("vec", -1).cast("double"), 6).alias("last"))


@query("SELECT 'k' || event_id % 40 AS stem, count(*) AS n FROM events GROUP BY 1")
def media_listing(t: Tables) -> DataFrame:
    """Files found below nested folders, one path a stem, joined to the rows that name them."""
    path = _place(t, "media")
    t.spark.range(0, 40, 1, 40).select((F.col("id") % 3).alias("d"), F.lit("x").alias("value")).write.partitionBy("d").text(path)  # a file for each task
    found = jsonl.media_index(t.spark, path, "*.txt")
    stems = found.select(F.concat(F.lit("k"), F.regexp_extract("stem", r"^part-(\d+)", 1).cast("int")).alias("stem"))
    return t.events.select(F.concat(F.lit("k"), F.col("event_id") % 40).alias("stem")).join(stems, "stem").groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(value) AS filled, NULL::VARCHAR AS note FROM events")
def summary_file(t: Tables) -> DataFrame:
    """A summary written as one JSON object, nulls included, and read back."""
    path = _place(t, "summary")
    sinks.write_summary(t.events.agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("filled"), F.lit(None).cast("string").alias("note")), path)
    return jsonl.read_jsonl(t.spark, path, "n bigint, filled bigint, note string", mode="strict").drop("ord")


@query("SELECT event_type AS label, round(avg(value), 3) AS score, count(*) AS n FROM events GROUP BY 1")
def leaderboard_files(t: Tables) -> DataFrame:
    """A leaderboard written as CSV and JSON; the rows that both have."""
    path = _place(t, "board")
    sinks.write_leaderboard(t.events.groupBy(F.col("event_type").alias("label")).agg(F.round(report.exact_mean(F.col("value")), 3).alias("score"), F.count(F.lit(1)).alias("n")), path)
    shape = "label string, score double, n bigint"
    return t.spark.read.schema(shape).csv(f"{path}/csv", header=True).intersect(t.spark.read.schema(shape).json(f"{path}/json"))


@query("SELECT event_id, round(exp(a - b), 6) AS ratio, round(least(exp(a - b) * adv, greatest(least(exp(a - b), 1.2), 0.8) * adv), 6) AS objective, greatest(least(exp(a - b), 1.2), 0.8) * adv < exp(a - b) * adv AS clipped FROM (SELECT event_id, (event_id % 17)::DOUBLE / 10 AS a, (event_id % 13)::DOUBLE / 8 AS b, (event_id % 7)::DOUBLE - 3 AS adv FROM events)")
def clipped_objective(t: Tables) -> DataFrame:
    x = lambda m: (F.col("event_id") % m).cast("double")
    c = contrastive.clipped_surrogate(x(17) / 10, x(13) / 8, x(7) - 3)
    return t.events.select("event_id", F.round(c["ratio"], 6).alias("ratio"), F.round(c["objective"], 6).alias("objective"), c["clipped"].alias("clipped"))


@query("SELECT event_id, 'v' || user_id || '|' || (event_id // 4) || ['.00', '.25', '.50', '.75'][1 + event_id % 4] || '|' || (event_id // 2) || CASE event_id % 2 WHEN 0 THEN '.00' ELSE '.50' END || '|d' || event_id % 9 AS segment FROM events")
def segment_ids(t: Tables) -> DataFrame:
    e = F.col("event_id").cast("double")
    return t.events.select("event_id", temporal.segment_id(F.concat(F.lit("v"), "user_id"), e / 4, e / 2, F.concat(F.lit("d"), F.col("event_id") % 9)).alias("segment"))
