"""Unions of datasets, shards and logs, with the rule that decides between rows of one key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelquery.operators.order import latest, log_key, numbered, one_per_key


def union_all(*parts: DataFrame) -> DataFrame:
    """Datasets one after the other (column `part` is the place of the dataset); columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])


def merge_matrices(*parts: DataFrame, key: str = "doc", vector: str = "vec", row: str = "row") -> DataFrame:
    """Vectors of several shards under one contiguous row number. A key in two rows or a second dimension is an error."""
    every = union_all(*parts)
    check = every.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("k"), F.countDistinct(F.size(vector)).alias("d")).first()
    if check["k"] != check["n"]:
        raise ValueError(f"{check['n'] - check['k']} rows repeat a {key}")
    if check["d"] > 1:
        raise ValueError("shards differ in dimension")
    return numbered(every, ["part", row], "__new").withColumn(row, F.col("__new")).drop("__new", "part")


def first_wins(df: DataFrame, key: str, ord: str) -> DataFrame:
    """The first row of each key; rows without a key all stay."""
    return one_per_key(df.where(F.col(key).isNotNull()), [key], ord).unionByName(df.where(F.col(key).isNull()))


def last_wins(df: DataFrame, index: str, ord: str) -> DataFrame:
    """The last row of each index; rows without one all stay, behind the others (column `place` sorts the output)."""
    kept = one_per_key(df.where(F.col(index).isNotNull()), [index], ord, "last")
    return kept.withColumn("place", F.struct(F.lit(0).alias("group"), F.col(index).cast("bigint").alias("at"))).unionByName(df.where(F.col(index).isNull()).withColumn("place", F.struct(F.lit(1).alias("group"), F.col(ord).cast("bigint").alias("at"))))


def override(current: DataFrame, other: DataFrame, index: str, qid: str, ord: str) -> DataFrame:
    """Two logs as one: the other's rows win over the current ones of the same key, later rows over earlier ones."""
    both = current.withColumn("__source", F.lit(0)).unionByName(other.withColumn("__source", F.lit(1)))
    w = Window.partitionBy("__key").orderBy(F.desc("__source"), F.desc(ord))
    keyed = both.withColumn("__key", log_key(F.col(index), F.col(qid), F.concat_ws("/", "__source", ord)))
    return keyed.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__key", "__source")


def failures(old: DataFrame, recovered: DataFrame, new: DataFrame, key: str, error: str, ord: str) -> DataFrame:
    """Old failures that weren't recovered, then new ones; each (key, error) once, the first."""
    left = old.join(recovered.select(key).distinct(), key, "left_anti").withColumn("__s", F.lit(0))
    both = left.unionByName(new.withColumn("__s", F.lit(1)))
    w = Window.partitionBy(key, error).orderBy("__s", ord)
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__s")


def merge_counts(df: DataFrame, key: str, bad: str) -> DataFrame:
    """One row: read, bad, unique, dropped, written (rows that stay when the first of a key wins and rows without one all stay)."""
    good = ~F.coalesce(F.col(bad), F.lit(False))
    k = F.when(good, F.col(key))
    out = df.agg(F.count(F.lit(1)).alias("read"), F.count_if(~good).alias("bad"), F.countDistinct(k).alias("unique"), F.count_if(good & F.col(key).isNull()).alias("free"), F.count(k).alias("keyed"))
    return out.select("read", "bad", "unique", (F.col("keyed") - F.col("unique")).alias("dropped"), (F.col("unique") + F.col("free")).alias("written"))


def latest_log(df: DataFrame, index: str, qid: str, ord: str, collapse: bool = False) -> DataFrame:
    """The last row of each log key, with `first_seen`."""
    return latest(df.withColumn("log_key", log_key(F.col(index), F.col(qid), F.col(ord), collapse)), "log_key", ord)
