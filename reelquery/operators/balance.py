"""Splits, caps, and up- and down-sampling. Random choices follow a hash of the row's key, so they repeat exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelquery.operators.negatives import hash_order
from reelquery.operators.order import numbered


def place(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds `__at`, the row's place (from 0) in hash order."""
    return numbered(df.withColumn("__h", hash_order(F.col(key), seed=seed)), ["__h", key], "__at").drop("__h")


def split(df: DataFrame, key: str, test_size: int, seed: int = 0) -> DataFrame:
    """Adds `split`: test for the first test_size rows in hash order, train for the rest."""
    return place(df, key, seed).withColumn("split", F.when(F.col("__at") < test_size, "test").otherwise("train")).drop("__at")


def split_ratio(df: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """Adds `split`: eval for max(1, round(n * ratio)) rows, with the ratio kept in [0.01, 0.99]."""
    n = df.count()
    return split(df, key, max(1, round(n * min(max(ratio, 0.01), 0.99))), seed).withColumn("split", F.when(F.col("split") == "test", "eval").otherwise("train"))


def head(df: DataFrame, ord: str, n: int) -> DataFrame:
    """The first n rows; all if n is 0 or less."""
    return df if n <= 0 else df.orderBy(ord).limit(n)


def sample_ratio(df: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """max(1, round(n * ratio)) rows in hash order."""
    n = max(1, round(df.count() * ratio))
    return df.withColumn("__h", hash_order(F.col(key), seed=seed)).orderBy("__h", key).limit(n).drop("__h")


def stratified(df: DataFrame, label: str, key: str, want: dict[str, int], seed: int = 0, allow_smaller: bool = True) -> DataFrame:
    """At most want[label] rows of each label, in hash order; 0 or less means all. Without allow_smaller, too few rows are an error."""
    if not allow_smaller:
        have = {r[0]: r[1] for r in df.where(F.col(label).isin(*want)).groupBy(label).count().collect()}
        short = [x for x, n in want.items() if n > have.get(x, 0)]
        if short:
            raise ValueError(f"too few rows of {short}")
    w = Window.partitionBy(label).orderBy("__h", key)
    most = F.coalesce(*[F.when(F.col(label) == x, F.lit(n if n > 0 else 1 << 62)) for x, n in want.items()])
    ranked = df.where(F.col(label).isin(*want)).withColumn("__h", hash_order(F.col(key), seed=seed)).withColumn("__rn", F.row_number().over(w))
    return ranked.where(F.col("__rn") <= most).drop("__h", "__rn")


def balanced(df: DataFrame, label: str, key: str, pos: str = "pos", neg: str = "neg", seed: int = 0) -> DataFrame:
    """As many rows of one label as of the other, in hash order; all rows of both if one has none."""
    have = {r[0]: r[1] for r in df.where(F.col(label).isin(pos, neg)).groupBy(label).count().collect()}
    n = min(have.get(pos, 0), have.get(neg, 0))
    if not n:
        return df.where(F.col(label).isin(pos, neg))
    return stratified(df, label, key, {pos: n, neg: n}, seed)


def upsampled(matched: int, not_matched: int, candidates: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """Rows to add so that ceil(not_matched * ratio) are matched: the candidates in hash order, again and again (column `cycle`), each cycle in an order of its own."""
    n = candidates.count()
    need = max(0, -int(-(not_matched * ratio) // 1) - matched)
    if not n or not need:
        return candidates.where(F.lit(False)).withColumn("cycle", F.lit(0))
    cycles = -(-need // n)
    every = candidates.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))))
    h = hash_order(F.col("cycle"), F.col(key), seed=seed)
    return every.withColumn("__h", h).orderBy("cycle", "__h", key).limit(need).drop("__h")


def repeated(df: DataFrame, ord: str, batch: int, mini_repeat: int, repeat_count: int) -> DataFrame:
    """ord, slot: the ragged tail behind the last whole batch is dropped; each batch comes repeat_count times, and in it every row mini_repeat times in a row."""
    out = numbered(df.select(ord), [ord], "__i")
    n = df.count() // batch * batch
    out = out.where(F.col("__i") < n).withColumn("b", F.floor(F.col("__i") / batch)).withColumn("p", F.col("__i") % batch)
    out = out.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(repeat_count - 1)))).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(mini_repeat - 1))))
    slot = ((F.col("b") * repeat_count + F.col("r")) * batch + F.col("p")) * mini_repeat + F.col("m")
    return out.select(ord, slot.cast("bigint").alias("slot"))


def chunks(df: DataFrame, ord: str, n: int) -> DataFrame:
    """Adds `chunk`: n runs of equal length, in order; the length is the count divided by n, and a rest belongs to the last."""
    size = max(1, df.count() // n)
    return numbered(df, [ord], "__i").withColumn("chunk", F.least(F.floor(F.col("__i") / size), F.lit(n - 1)).cast("int")).drop("__i")


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Adds `at`, a permutation that all columns of a row share."""
    return place(df, key, seed).withColumnRenamed("__at", "at")


def hash_rank(key: Column, seed: int = 0) -> Column:
    return hash_order(key, seed=seed)
