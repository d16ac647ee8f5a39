"""Cohort retention matrix from bucketed, persisted tables.

Clicks, starts and clients are written as tables bucketed and sorted by (client_id, slice), so that they are joined bucket by
bucket, by sort-merge joins without a shuffle. Within a bucket clicks become one row for each client and cell; these are
summed into partial cells, and only the partial cells are shuffled and added up.

A client with more than 1/(4 b) of the clicks, b being the number of buckets, is cut into slices of about that many, by a
hash of the row: its starts and its city stand in every slice, its clicks in one. There can be at most 4 b such clients,
which bounds the list that is broadcast, and no bucket holds a hot client whole. A sliced client may have a row for the
same cell in several slices; partial cells keep such clients by name, so that they count once.

Clicks are shuffled once, as narrow rows: equal rows have one slice, so they meet and are counted once in the task that writes the
bucket. Starts come from an aggregate that needs no such care, as a repeated click doesn't move a minimum.

Defined results: clicks without a time or a client are left out; a click without an id arrives when `arrived_at` says; one
without an arrival is known to the last state only; a null, infinite or NaN value counts 0 cents; a client that the clients
table doesn't have, or whose city is null, has the segment ''; of several rows of a client the one with the latest
`updated_at` counts, then the greatest city; timestamps with or without a zone are taken as they stand in UTC; empty tables
give no cells; further columns of clicks only tell rows apart.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType, TimestampNTZType, VariantType

from reelquery.llm.common import Scratch, crc_of, delete, new_path, shuffle_partitions

DAY = 86_400_000_000
#: Slices of a hot client: so many for each bucket that the client would fill.
SLICES = 4
#: Buckets that Spark allows, and clicks in a bucket beyond which there are more buckets than shuffle partitions.
MOST_BUCKETS, ROWS = 100_000, 4_000_000


class Buckets(NamedTuple):
    """Names and folders of the three tables."""

    clicks: tuple[str, str]
    starts: tuple[str, str]
    clients: tuple[str, str]

    def drop(self, spark: SparkSession) -> None:
        for name, path in self:
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
            delete(spark, path)


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp as it stands, whatever the session's zone."""
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, TimestampNTZType):
        return ((c - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).cast("decimal(20,6)") * 1_000_000).cast("bigint")
    return F.unix_micros(c)


def floor_div(a: Column, b: int) -> Column:
    return ((a - F.pmod(a, F.lit(b))) / b).cast("bigint")


def _same(df: DataFrame, columns: list[str]) -> list[Column]:
    """Columns k0, k1, ... that are equal just where the given columns are: texts by their md5, nested values by two hashes."""
    out: list[Column] = []
    for name in columns:
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType
        if isinstance(kind, StringType | BinaryType):
            out.append(F.unhex(F.md5(c.cast("binary"))))
        elif isinstance(kind, MapType | VariantType):
            out.append(F.unhex(F.md5(F.to_json(F.struct(c)))))
        elif isinstance(kind, ArrayType | StructType):
            out += [c.isNull(), F.xxhash64(c), F.xxhash64(F.lit(7), c)]
        else:
            out.append(c)
    return [c.alias(f"k{i}") for i, c in enumerate(out)]


def _write(df: DataFrame, buckets: int, what: str) -> tuple[str, str]:
    """A table bucketed and sorted by (client_id, slice), one file a bucket, in the shared folder."""
    spark = df.sparkSession
    name, path = f"{what}_{uuid.uuid4().hex}", new_path(spark, f"buckets-{what}")
    df.write.format("parquet").bucketBy(buckets, "client_id", "slice").sortBy("client_id", "slice").option("path", path).saveAsTable(name)
    return name, path


def write_buckets(clicks: DataFrame, clients: DataFrame, arrives: Column, known_before: int) -> Buckets:
    """The three tables. arrives: when a click is known, in microseconds; known_before: what the first state knows.

    clicks: client_id, at, early (known to the first state), cents; starts: client_id, start0, start1, sliced; clients: client_id,
    segment; all with their slice.
    """
    spark = clicks.sparkSession
    kept = Scratch(spark)
    at = micros(clicks, "ts")
    early = F.coalesce(arrives < known_before, F.lit(False))
    cents = F.when(F.abs("value") < float("inf"), F.floor(100 * F.col("value") + 0.5)).otherwise(F.lit(0)).cast("bigint")
    good = clicks.where("ts is not null and client_id is not null")
    bought = F.col("kind") == "purchase"
    starts = kept.keep(good.select(F.col("client_id").cast("bigint").alias("client_id"), at.alias("at"), early.alias("early"), bought.alias("bought")).groupBy("client_id").agg(F.min(F.when(F.col("early") & F.col("bought"), F.col("at"))).alias("start0"), F.min(F.when(F.col("bought"), F.col("at"))).alias("start1"), F.count(F.lit(1)).alias("n")).where("start1 is not null"))
    total = starts.agg(F.sum("n")).first()[0] or 0
    n = min(max(shuffle_partitions(spark), -(-total // ROWS)), MOST_BUCKETS)
    most = max(1, total // (SLICES * n))
    slices = F.ceil(F.col("n") / most).cast("int")
    hot = F.broadcast(starts.where(F.col("n") > most).select("client_id", slices.alias("slices")))  # at most SLICES * n rows
    each = lambda df: df.withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
    by = (n, "client_id", "slice")

    s = each(starts.withColumn("slices", slices)).select("client_id", "slice", "start0", "start1", (F.col("slices") > 1).alias("sliced"))
    first = _write(s.repartition(*by), n, "starts")

    who = clients.where("client_id is not null").groupBy(F.col("client_id").cast("bigint").alias("client_id")).agg(F.max(F.struct("updated_at", "city"))["city"].alias("city"))
    c = each(who.join(hot, "client_id", "left")).select("client_id", "slice", F.coalesce("city", F.lit("")).alias("segment"))
    second = _write(c.repartition(*by), n, "clients")

    same = _same(clicks, [x for x in clicks.columns if x not in ("client_id", "ts")])
    rows = good.select(F.col("client_id").cast("bigint").alias("client_id"), at.alias("at"), early.alias("early"), cents.alias("cents"), *same)
    keys = [x for x in rows.columns if x.startswith("k")]
    own = F.pmod(F.xxhash64("at", *keys), F.coalesce("slices", F.lit(1)).cast("bigint")).cast("int")
    dealt = rows.join(hot, "client_id", "left").withColumn("slice", own).drop("slices").repartition(*by)
    once = dealt.dropDuplicates(["client_id", "slice", "at", *keys]).select("client_id", "slice", "at", "early", "cents")
    third = _write(once, n, "clicks")
    kept.drop()
    return Buckets(third, first, second)


def cells(spark: SparkSession, tables: Buckets, days: int) -> DataFrame:
    """The cells of both states, from the bucketed tables."""
    clicks, starts, clients = (spark.table(f"`{name}`") for name, _ in tables)
    width = days * DAY
    on = ["client_id", "slice"]
    joined = clicks.join(starts.hint("merge"), on).join(clients.hint("merge"), on, "left")
    moved = F.coalesce(floor_div(F.col("start0"), width) != floor_div(F.col("start1"), width), F.lit(False))
    view = lambda k, known: F.when(known & (F.col("at") >= F.col(f"start{k}")), F.struct(F.lit(k).alias("state"), floor_div(F.col(f"start{k}"), width).alias("cohort"), floor_div(F.col("at") - F.col(f"start{k}"), width).alias("period")))
    views = F.filter(F.array(view(0, F.col("early")), view(1, F.lit(True))), lambda x: x.isNotNull())
    seen = joined.select(*on, "sliced", F.coalesce("segment", F.lit("")).alias("segment"), moved.alias("moved"), "cents", F.explode(views).alias("v")).select("*", "v.*")
    cell = ["state", "segment", "cohort", "period"]
    # One row for each client, slice and cell: no shuffle, as buckets hold all rows of a slice.
    own = seen.groupBy(*on, *cell, "sliced", "moved").agg(F.sum("cents").alias("cents"))
    own = own.select(*cell, F.when(F.col("sliced"), F.col("client_id")).alias("who"), crc_of("client_id").alias("crc"), F.col("moved").cast("bigint").alias("moved"), "cents")
    partial = own.groupBy(*cell, "who").agg(F.count(F.lit(1)).alias("users"), F.sum("crc").alias("crcs"), F.max("crc").alias("crc"), F.sum("moved").alias("moves"), F.max("moved").alias("moved"), F.sum("cents").alias("cents"))
    named = F.col("who").isNotNull()
    once = partial.select(*cell, F.when(named, F.lit(1)).otherwise(F.col("users")).alias("users"), F.when(named, F.col("crc")).otherwise(F.col("crcs")).alias("users_crc32"), F.when(named, F.col("moved")).otherwise(F.col("moves")).alias("moved"), "cents")
    return once.groupBy(*cell).agg(*[F.sum(x).alias(x) for x in ("users", "users_crc32", "moved", "cents")])


def retention(clicks: DataFrame, clients: DataFrame, *, arrives: Column, known_before: int, days: int = 3) -> DataFrame:
    """state, segment, cohort, period, users, users_crc32, moved, cents of every nonempty cell.

    State 0 knows the clicks that arrive before `known_before` (microseconds), state 1 all. The bucketed tables are dropped
    when the cells stand in a table of their own.
    """
    spark = clicks.sparkSession
    tables = write_buckets(clicks, clients, arrives, known_before)
    out = Scratch(spark).keep(cells(spark, tables, days))
    tables.drop(spark)
    return out


def op12(clicks: DataFrame, clients: DataFrame) -> DataFrame:
    h = crc_of("click_id")
    late = F.when(h % 3 == 0, h % 100).otherwise(F.lit(0))
    arrives = micros(clicks, "arrived_at") + F.coalesce(late, F.lit(0)) * DAY
    return retention(clicks, clients, arrives=arrives, known_before=1_709_251_200_000_000, days=3)  # 2024-03-01 00:00
