"""Connected components of links, and joins that bear one key with a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelquery.llm.common import cut

#: So many links at most (2 MB) are one task in a round; more are shuffled.
FEW_LINKS = 1 << 17


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join on the column `key` that adaptive execution can split where one key is hot.

    Splitting needs an exchange right below both sides. The key's hash as a second key sees to it: a side that is
    already dealt by `key`, such as an aggregate, is dealt again.
    """
    extra = f"__h_{key}"
    a = left.withColumn(extra, F.xxhash64(key))
    b = right.withColumn(extra, F.xxhash64(key))
    return a.join(b, [key, extra], how).drop(extra)


def components(edges: DataFrame, most: int | None = None, most_rounds: int = 60) -> DataFrame:
    """Columns `node` and `comp` (the smallest node reachable) for every node of the links (a, b), both bigint.

    Alternates large-star and small-star steps: each gives all neighbours of a node to its smallest neighbour, so a
    component becomes a star around its smallest node in a few rounds and the number of links never grows. Stars of
    any size are aggregated before they are shuffled; joins bear hot nodes. Rounds are cut with checkpoint(). While
    links are few (`most`: no more than so many, where the caller knows), a round is one task without a shuffle, instead
    of thousands of empty ones that the driver has to keep account of.
    """
    e = edges if most is None else _packed(edges, most)
    e = cut(e.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(e)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        e = cut(_few_round(_packed(e, mark[0])) if mark[0] <= FEW_LINKS else _round(e))
        new = _mark(e)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components are not stars after {most_rounds} rounds")
    e = _packed(e, mark[0])
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(e.select("b", "b").distinct())


def _packed(links: DataFrame, n: int) -> DataFrame:
    """The links, in one partition if they are few (n: how many at most)."""
    return links.coalesce(1) if n <= FEW_LINKS else links


def _few_round(e: DataFrame) -> DataFrame:
    """The same as `_round`, of links in one partition: windows need no shuffle there, joins would."""
    of_a = Window.partitionBy("a")
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = e.select(F.explode(ways).alias("x")).select("x.a", "x.b")
    large = both.withColumn("m", F.least("a", F.min("b").over(of_a))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    ends = F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))
    small = large.withColumn("m", F.min("b").over(of_a)).select(F.explode(ends).alias("x")).select("x.a", F.col("x.m").alias("b"))
    return small.where("a <> b").distinct()


def _round(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = spread_join(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = spread_join(large, least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
    return r[0], r[1] or 0
