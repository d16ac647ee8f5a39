"""JSON lines, JSON arrays, matrices and id maps as DataFrames. Row order is meaning, so readers add `ord`.

Lines are read as text and parsed with the JSON parser, not by the JSON source: that source would take a wrong type
for a broken line and a one-line array for a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelquery.sources import documents


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line: every line that isn't blank, with `ord`, its place by file and offset (contiguous from 0).

    A range of a file is read by one task, in order, so a line's place is its place in the range and how many lines the
    ranges before hold (one row a range): lines are counted once and read once, and never shuffled for it.
    """
    text = spark.read.text(path).where("trim(value) <> ''")
    raw = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("__m"), F.col("value").alias("line"))
    ranges = raw.groupBy("file", "block").agg(F.min("__m").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("file", "block", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return raw.join(ranges, ["file", "block"]).select("file", (F.col("__before") + F.col("__m") - F.col("__first")).alias("ord"), "line")


def parsed(df: DataFrame, schema: StructType | str, line: str = "line") -> DataFrame:
    """Adds `row` (the object read with the schema; values of another type are null) and `bad` (no JSON object)."""
    v = F.try_parse_json(line)
    ok = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
    return df.withColumn("bad", ~F.coalesce(ok, F.lit(False))).withColumn("row", F.when(~F.col("bad"), F.from_json(line, schema, {"mode": "PERMISSIVE"})))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, mode: str = "skip") -> DataFrame:
    """ord and the schema's columns. mode: `strict` fails on the first bad line, `skip` leaves bad lines out."""
    df = parsed(lines(spark, path), schema)
    if mode == "strict":
        df = df.withColumn("row", F.when(F.col("bad"), F.raise_error(F.concat(F.lit("no JSON object in line "), F.col("ord").cast("string")))).otherwise(F.col("row")))
    elif mode != "skip":
        raise ValueError("mode is strict or skip")
    else:
        df = df.where("not bad")
    return df.select("ord", "row.*")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """good, bad: how many lines are JSON objects and how many aren't."""
    df = parsed(lines(spark, path), "a string")
    return df.agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"))


def warnings(spark: SparkSession, path: str, most: int = 5) -> DataFrame:
    """ord, line of the first `most` lines that are no JSON objects: what is shown beside the counts of `bad_lines`."""
    return parsed(lines(spark, path), "a string").where("bad").select("ord", "line").orderBy("ord").limit(most)


def read_any(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """ord and the schema's columns of JSON lines, of an array, or of an object with a `data` array; elements that are no objects are left out.

    `.jsonl` means lines. Any other file is told by its whole structure: an array if it begins with a bracket; if it is one
    object with an array `data`, that array; else lines. Files of a folder are of one kind. Arrays and objects are read in parallel
    (`documents`); one that doesn't end is an error. ord is an element's place in its file, and 2^40 more for each file before.
    """
    if path.rstrip("/").endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    p = documents.held(spark, path)
    found = documents.shape(spark, path, p)
    kind = F.when(F.col("head") == "[", "array").when((F.col("head") == "{") & (F.col("values") == 1), "object").otherwise("lines")
    kinds = {(r[0], r[1]) for r in found.select(kind, F.when(kind != "lines", F.col("balanced"))).distinct().collect()}  # a few
    names = {k for k, _ in kinds}
    if ("array", False) in kinds or ("object", False) in kinds:
        raise ValueError(f"{path}: an array or object that doesn't end")
    if names == {"array"}:
        each = documents.members(spark, path, p=p)
    elif names == {"object"} and documents.has_array(spark, path, "data", p):
        each = documents.members(spark, path, under="data", p=p)
    elif names <= {"lines", "object"}:
        p.unpersist()
        return read_jsonl(spark, path, schema)
    else:
        raise ValueError(f"{path} holds arrays beside lines")
    each = each.join(documents.files(spark, path, p), "file").select((F.col("number") * (1 << 40) + F.col("place") - 1).alias("ord"), F.col("text").alias("line"))
    return parsed(each, schema).where("not bad").select("ord", "row.*")


def id_rows(spark: SparkSession, path: str) -> DataFrame:
    """doc, row: a JSON object of any size that maps ids to rows, sorted by row."""
    each = documents.members(spark, path)
    pair = F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string,int>")
    return each.select(F.explode(pair).alias("doc", "row")).orderBy("row")


def read_matrix(spark: SparkSession, path: str, meta: DataFrame | None = None, rows: int = 65536) -> DataFrame:
    """row, vec of .npy matrices (a file or a folder of them, in order of their names), read by ranges of rows; with meta, the number of rows must be the same."""
    from reelquery.sources.matrix import NpySource

    spark.dataSource.register(NpySource)
    out = spark.read.format("npy").option("rows", rows).load(path)
    if meta is not None and (n := out.select("row").count()) != (m := meta.count()):
        raise ValueError(f"{n} vectors, {m} rows of meta data")
    return out


def with_meta(matrix: DataFrame, meta: DataFrame, ord: str = "ord") -> DataFrame:
    """Matrix rows beside the meta row of the same place: row, vec, and the columns of meta but `ord` (contiguous from 0)."""
    return matrix.join(meta.withColumnRenamed(ord, "row"), "row")


def media_index(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """stem, path: media files below a folder, the first path of each stem; contents aren't read."""
    from reelquery.functions.parse import stem

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path")
    return files.groupBy(stem(F.col("path")).alias("stem")).agg(F.min("path").alias("path"))
