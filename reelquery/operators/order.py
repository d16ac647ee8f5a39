"""Row order that carries meaning: contiguous numbers, shards, first and last of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges for each shuffle partition, rows of the sample for each range, and of the whole sample at most.
_RANGES, _SAMPLED, _SAMPLE = 4, 32, 200_000


def _tie(df: DataFrame) -> Column:
    """A hash of the columns that can be hashed."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))])


def in_ranges(df: DataFrame, by: list[str], name: str = "__part") -> DataFrame:
    """Adds the number of the range of `by` that a row lies in, from 0 on, as a pure expression of the row.

    The bounds come from the rows with the smallest hashes, a bounded sample that is the same whenever the frame is
    read, so every branch of a plan deals rows alike. A hash of the row ends the key: equal values of `by` that
    many rows share are spread over several ranges.
    """
    n = min(_RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), _SAMPLE // 2)
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(by)], _tie(df).alias("tie"))
    sample = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(min(_SAMPLED * n, _SAMPLE))
    keys = F.sort_array(F.collect_list("k"))
    at = lambda i: F.element_at(F.col("keys"), (F.floor(i * F.size("keys") / n) + 1).cast("int"))
    bounds = sample.agg(keys.alias("keys")).select(F.when(F.size("keys") > 0, F.transform(F.sequence(F.lit(1), F.lit(n - 1)), at)).alias("bounds"))
    # How many bounds are not above the key, found by halving: no bound is looked at twice.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s < n) & (F.element_at(F.col("__bounds"), F.least(lo + s, F.lit(n - 1))) <= F.col("__key")), lo + s).otherwise(lo))
    placed = df.withColumns({"__key": key, "__bounds": bounds.scalar()})
    return placed.withColumn(name, F.when(F.col("__bounds").isNull(), 0).otherwise(found)).drop("__key", "__bounds")


def numbered(df: DataFrame, by: list[str], name: str, start: int = 0) -> DataFrame:
    """Adds start, start+1, ... in order of the columns `by`, without gathering all rows in one task: rows are dealt by ranges, numbered in each range, and shifted by the sizes of the ranges before (one row a range). The frame has to give the same rows whenever it is read; an order among equal `by` is the one of a hash of the rows."""
    ranged = in_ranges(df, by)
    own = Window.partitionBy("__part").orderBy(*by, _tie(df))
    inside = ranged.withColumn("__rn", F.row_number().over(own))
    sizes = ranged.groupBy("__part").count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    shift = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    return inside.join(F.broadcast(shift), "__part").withColumn(name, (F.col("__before") + F.col("__rn") - 1 + start).cast("bigint")).drop("__part", "__rn", "__before")


def running(df: DataFrame, by: list[str], sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None) -> DataFrame:
    """Adds running sums of columns (up to and with the row) and last values that aren't null, in order of `by` (whose values are distinct): sums and lasts map a new column to its source. Like `numbered`, it works range by range with one row a range in between."""
    sums, lasts = sums or {}, lasts or {}
    ranged = in_ranges(df, by)
    upto = Window.partitionBy("__part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct(*by)
    inside = ranged.withColumns({f"__s_{k}": F.sum(v).over(upto) for k, v in sums.items()} | {f"__l_{k}": F.last(v, ignorenulls=True).over(upto) for k, v in lasts.items()})
    parts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(v).alias(f"__t_{k}") for k, v in sums.items()], *[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), at)).alias(f"__e_{k}") for k, v in lasts.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    carry = parts.select("__part", *[F.sum(f"__t_{k}").over(before).alias(f"__b_{k}") for k in sums], *[F.last(f"__e_{k}", ignorenulls=True).over(before).alias(f"__c_{k}") for k in lasts])
    out = inside.join(F.broadcast(carry), "__part")
    new = {k: F.coalesce(f"__b_{k}", F.lit(0)) + F.coalesce(f"__s_{k}", F.lit(0)) for k in sums} | {k: F.coalesce(f"__l_{k}", f"__c_{k}") for k in lasts}
    return out.select(*df.columns, *[c.alias(k) for k, c in new.items()])


def shard(df: DataFrame, by: list[str], shards: int, which: int | None = None) -> DataFrame:
    """Deals rows round-robin in order of `by`: column shard is i % shards; with `which`, only that shard."""
    out = numbered(df, by, "__i").withColumn("shard", F.pmod("__i", F.lit(shards)).cast("int")).drop("__i")
    return out if which is None else out.where(F.col("shard") == which)


def one_per_key(df: DataFrame, keys: list[str], ord: str, keep: str = "first") -> DataFrame:
    """The first or last row of each key by the order column; null keys are keys like any other."""
    if keep not in ("first", "last"):
        raise ValueError("keep is first or last")
    order = F.asc(ord) if keep == "first" else F.desc(ord)
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def log_key(index: Column, qid: Column, ord: Column, collapse: bool = False) -> Column:
    """The key of a log row: idx:N, else qid:X, else row:N by its place (with `collapse`, all such rows share qid:)."""
    q = F.trim(F.coalesce(qid, F.lit("")))
    rest = F.lit("qid:") if collapse else F.concat(F.lit("row:"), ord.cast("string"))
    return F.when(index.isNotNull(), F.concat(F.lit("idx:"), index.cast("string"))).when(q != "", F.concat(F.lit("qid:"), q)).otherwise(rest)


def latest(df: DataFrame, key: str, ord: str) -> DataFrame:
    """The last row of each key, with `first_seen`, the place at which the key came first (the order of the output). Aggregated before the shuffle, so a key of many rows is no burden."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    found = df.groupBy(key).agg(F.max_by(row, F.col(ord)).alias("__last"), F.min(ord).alias("__first"))
    return found.select(*[F.col(f"__last.`{c}`").alias(c) for c in df.columns], F.col("__first").alias("first_seen"))


def distinct_in_order(df: DataFrame, key: str, ord: str) -> DataFrame:
    """Each key once, with the place where it came first."""
    return df.groupBy(key).agg(F.min(ord).alias("first_seen"))


def common_first(df: DataFrame, key: str, ord: str) -> DataFrame:
    """key, n, first_seen; sorted by falling count, then by first appearance."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(ord).alias("first_seen")).orderBy(F.desc("n"), "first_seen")


def capped_per_group(df: DataFrame, group: str, ord: str, most: int, groups: int | None = None) -> DataFrame:
    """At most `most` rows of each group, in order. With `groups`, reading stops at the first place where at least so many groups have been seen and every group seen is full; the rows before it are kept."""
    w = Window.partitionBy(group).orderBy(ord)
    ranked = df.withColumn("__rn", F.row_number().over(w))
    kept = ranked.where(F.col("__rn") <= most)
    if groups is None:
        return kept.drop("__rn")
    # A group opens at its first row and fills at its row `most`; the rest of the order is of groups, not rows.
    events = kept.where(F.col("__rn") == 1).select(F.col(ord).alias("__at"), F.lit(1).alias("o"), F.lit(0).alias("f"))
    events = events.union(kept.where(F.col("__rn") == most).select(F.col(ord), F.lit(0), F.lit(1)))
    opened = events.groupBy("__at").agg(F.sum("o").alias("o"), F.sum("f").alias("f"))
    state = running(opened, ["__at"], sums={"seen": "o", "full": "f"})
    stop = state.where((F.col("seen") >= groups) & (F.col("seen") == F.col("full"))).agg(F.min("__at").alias("__stop"))
    return kept.crossJoin(F.broadcast(stop)).where(F.col("__stop").isNull() | (F.col(ord) <= F.col("__stop"))).drop("__rn", "__stop")
