"""Append-only logs as streams: resume, live metrics, upserts, and what is still to be done.

Batches are written to snapshot tables (`sources.snapshots`), whose manifest knows the last batch of each stream: a batch that
runs again after a failure adds nothing. What a table holds already is found in the table itself, so no query keeps
state that grows, in a state store or on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelquery.operators.order import log_key
from reelquery.sources.snapshots import Table, last_rows


def log_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder to which JSON line files are added, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def _each_batch(stream: DataFrame, checkpoint: str, put: Callable[[DataFrame, int], None], every: str | None = None, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def append(stream: DataFrame, out: str, checkpoint: str, key: str | None = None, at: str | None = None, within: int | None = None, every: str | None = None) -> StreamingQuery:
    """Appends a stream to a snapshot table, each row once however often the query is restarted; with a key, each key once.

    A key is looked up in the committed parts whose range of keys meets the batch's; with `at` (bigint) and `within`, only in
    parts that aren't older than that. Streams are told apart by their checkpoint, so several may write one table.
    """

    def put(batch: DataFrame, number: int) -> None:
        table = Table(batch.sparkSession, out)
        if key:
            table.append_new(batch, key, checkpoint, number, at, within)
        else:
            table.append(batch, checkpoint, number)

    return _each_batch(stream, checkpoint, put, every)


def appended(spark: SparkSession, out: str) -> DataFrame:
    """What streams have appended or put so far."""
    return Table(spark, out).read()


def remaining(todo: DataFrame, *logs: DataFrame, key: str) -> DataFrame:
    """What no log has done yet."""
    out = todo
    for log in logs:
        out = out.join(log.select(key).distinct(), key, "left_anti")
    return out


def keyed(rows: DataFrame, rank: str = "rank", index: str = "index", qid: str = "qid", at: str = "at") -> DataFrame:
    """log_key, rank, at of log rows."""
    return rows.select(log_key(F.col(index), F.col(qid), F.col(at)).alias("log_key"), F.col(rank).alias("rank"), F.col(at).alias("at"))


def watch(stream: DataFrame, out: str, checkpoint: str, key: str, at: str, metrics: list[Column] = (), report: str | None = None, every: str | None = None) -> StreamingQuery:
    """Keeps the last row of each key in a snapshot table, batch by batch; with `metrics` (aggregates of that table) and `report`,
    each batch adds a row with its number and the metrics as they stand to the table `report`."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        Table(spark, out).upsert(batch, key, at, checkpoint, number)
        if report:
            Table(spark, report).append(Table(spark, out).read().agg(*metrics).select(F.lit(number).cast("bigint").alias("batch"), "*"), checkpoint, number)

    return _each_batch(stream, checkpoint, put, every)


def upsert_batches(stream: DataFrame, out: str, checkpoint: str, key: str, at: str) -> StreamingQuery:
    """Puts each batch's last row of a key into a snapshot table that reads back merged (`appended`)."""

    def put(batch: DataFrame, number: int) -> None:
        Table(batch.sparkSession, out).upsert(batch, key, at, checkpoint, number)

    return _each_batch(stream, checkpoint, put)


__all__ = ["append", "appended", "keyed", "last_rows", "log_stream", "remaining", "upsert_batches", "watch"]
