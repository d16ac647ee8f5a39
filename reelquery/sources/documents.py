"""Large JSON documents, read in parallel: one array or object of any size is cut into its members by several tasks.

The text source splits a file into ranges of bytes and cuts it at commas. Whether a comma parts two members depends on
what stands before it: is it inside a string, and how deep. So each range is summed up for both ways in which it may
begin (inside a string or not), the sums are combined along the file (one row a range), and then every piece knows its own
state. Pieces between two commas of the member level are joined again. No task holds more than a range or a member.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FILE = ["file", "block"]


def _brackets(outside: Column) -> Column:
    return F.regexp_replace(outside, r"[^\[\]{}]", "")


def _delta(brackets: Column) -> Column:
    closing = F.length(F.regexp_replace(brackets, r"[\[{]", ""))
    return F.length(brackets) - 2 * closing


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, n, text of what stands between commas; quotes (how many aren't escaped); b0 and b1, its brackets outside of strings if it begins outside or inside of one."""
    raw = spark.read.option("lineSep", ",").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("text"))
    plain = raw.withColumn("p", F.regexp_replace("text", r"(?s)\\.", ""))
    outside = lambda t: _brackets(F.regexp_replace(t, r'(?s)"[^"]*("|$)', ""))
    quotes = F.length("p") - F.length(F.replace(F.col("p"), F.lit('"'), F.lit("")))
    return plain.withColumns({"quotes": quotes, "b0": outside(F.col("p")), "b1": outside(F.concat(F.lit('"'), F.col("p")))}).drop("p")


def files(spark: SparkSession, path: str, p: DataFrame | None = None) -> DataFrame:
    """file, number: the files of a path, numbered by their names from 0."""
    found = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file")) if p is None else p.select("file")
    names = found.distinct()
    return names.withColumn("number", (F.row_number().over(Window.orderBy("file")) - 1).cast("bigint"))  # one row a file


def _ahead(df: DataFrame, by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def placed(spark: SparkSession, path: str) -> DataFrame:
    """Pieces with `inside` (whether they begin inside of a string), `depth` (how many brackets are open there) and `brackets`."""
    p = pieces(spark, path)
    own = _ahead(p, _FILE, "n")
    p = p.withColumn("odd", F.coalesce(F.sum("quotes").over(own), F.lit(0)) % 2)
    d0, d1 = _delta(F.col("b0")), _delta(F.col("b1"))
    p = p.withColumns({"e0": F.when(F.col("odd") == 0, d0).otherwise(d1), "e1": F.when(F.col("odd") == 0, d1).otherwise(d0)})
    sums = p.groupBy(*_FILE).agg((F.sum("quotes") % 2).alias("parity"), F.sum("e0").alias("t0"), F.sum("e1").alias("t1"))
    before = _ahead(sums, ["file"], "block")
    sums = sums.withColumn("begins", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2)
    sums = sums.withColumn("open", F.coalesce(F.sum(F.when(F.col("begins") == 0, F.col("t0")).otherwise(F.col("t1"))).over(before), F.lit(0)))
    p = p.join(sums.select(*_FILE, "begins", "open"), _FILE)
    p = p.withColumn("e", F.when(F.col("begins") == 0, F.col("e0")).otherwise(F.col("e1")))
    inside = (F.col("odd") + F.col("begins")) % 2 == 1
    depth = F.col("open") + F.coalesce(F.sum("e").over(own), F.lit(0))
    return p.select(*_FILE, "n", "text", inside.alias("inside"), depth.alias("depth"), "e", F.when(inside, F.col("b1")).otherwise(F.col("b0")).alias("brackets"))


def held(spark: SparkSession, path: str) -> DataFrame:
    """What `placed` gives, worked out once and held on the executors' disks: all that is asked of a path reads this."""
    return placed(spark, path).persist(StorageLevel.DISK_ONLY)


def _running(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Adds for each name how many rows of the file up to and with this one have its flag."""
    df = df.withColumns({f"__f_{n}": f.cast("int") for n, f in flags.items()})
    upto = Window.partitionBy(*_FILE).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    counts = df.groupBy(*_FILE).agg(*[F.sum(f"__f_{n}").alias(f"__c_{n}") for n in flags])
    counts = counts.select(*_FILE, *[F.coalesce(F.sum(f"__c_{n}").over(_ahead(counts, ["file"], "block")), F.lit(0)).alias(f"__b_{n}") for n in flags])
    out = df.join(counts, _FILE).withColumns({n: F.col(f"__b_{n}") + F.sum(f"__f_{n}").over(upto) for n in flags})
    return out.drop(*[f"__{x}_{n}" for x in "fb" for n in flags])


def members(spark: SparkSession, path: str, under: str | None = None, p: DataFrame | None = None) -> DataFrame:
    """file, place, text: the members of the top-level array or object of each file (an object's as `"key": value`), or with
    `under` the elements of the array that the top-level object has by that key. place orders them within the file. p: what `held` gives, if it is there."""
    p = held(spark, path) if p is None else p
    cut = ~F.col("inside")
    if under is None:
        p = _running(p, {"place": cut & (F.col("depth") <= 1)})
        head, tail = r"(?s)^[\s\uFEFF]*[\[{]", r"(?s)[\]}]\s*$"
        ends = F.col("last") == 0
        whole = p
    else:
        opens = _opens(under)
        p = _running(p, {"key": cut & (F.col("depth") <= 1), "place": cut & (F.col("depth") <= 2)})
        keys = p.where(cut & (F.col("depth") <= 1) & F.col("text").rlike(opens)).groupBy("file").agg(F.min("key").alias("key"))
        whole = p.join(keys, ["file", "key"])
        head, tail = opens, r"(?s)\]\s*(\}\s*)?$"
        ends = F.col("last") <= 1
    whole = whole.withColumn("first", F.col("text").rlike(head) & cut & (F.col("depth") <= (0 if under is None else 1)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "n", "text"))), lambda x: x["text"]), ",")
    last = F.max_by(F.col("depth") + F.col("e"), F.struct("block", "n"))
    out = whole.groupBy("file", "place").agg(text.alias("text"), F.bool_or("first").alias("first"), last.alias("last"))
    bare = F.when(F.col("first"), F.regexp_replace("text", head, "")).otherwise(F.col("text"))
    out = out.withColumn("text", bare).withColumn("text", F.when(ends, F.regexp_replace("text", tail, "")).otherwise(F.col("text")))
    return out.where(F.col("text").rlike(r"\S")).select("file", "place", F.trim("text").alias("text"))


def has_array(spark: SparkSession, path: str, key: str, p: DataFrame | None = None) -> bool:
    """Whether the top-level object of any file has an array by that key."""
    p = placed(spark, path) if p is None else p
    return bool(p.where(~F.col("inside") & (F.col("depth") <= 1) & F.col("text").rlike(_opens(key))).limit(1).count())


def _opens(key: str) -> str:
    return rf'(?s)^[\s\uFEFF]*\{{?\s*"{key}"\s*:\s*\['


def shape(spark: SparkSession, path: str, p: DataFrame | None = None) -> DataFrame:
    """file, head (its first character that isn't blank), values (how many top-level arrays and objects it has), balanced."""
    p = placed(spark, path) if p is None else p
    hits = F.aggregate(F.split("brackets", ""), F.struct(F.col("depth").cast("bigint").alias("d"), F.lit(0).alias("z")), lambda a, c: _count(a, c))["z"]
    ends = F.when(F.col("brackets").rlike(r"[\]}]"), hits).otherwise(F.lit(0))
    first = F.substring(F.regexp_replace("text", r"^[\s\uFEFF]+", ""), 1, 1)
    out = p.groupBy("file").agg(F.min_by(first, F.struct("block", "n")).alias("head"), F.sum(ends).alias("values"), F.sum("e").alias("open"))
    return out.select("file", "head", "values", (F.col("open") == 0).alias("balanced"))


def _count(a: Column, c: Column) -> Column:
    d = a["d"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
    return F.struct(d.cast("bigint").alias("d"), (a["z"] + (c.isin("]", "}") & (d == 0)).cast("int")).alias("z"))
