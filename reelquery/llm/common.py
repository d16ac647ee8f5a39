"""What the operators share: the shared folder, cutting lineage, reading tables, and batches of rows in Python."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column that carries the caller's row through a Python stage; no input column can clash with what is computed.
ROW = "__row"
#: Whether an action's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A Python stage takes the documents of an Arrow batch in groups of about so many bytes, which bounds its arrays.
GROUP_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`; a temporary one only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="reelquery-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, held in the shared folder (not on an executor's own disk)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Frames made within it leave no shuffle files behind their actions, so steps that follow each other take the disk of the largest, not of all. Frames that the caller gets are made outside: a second action on one would shuffle again."""
    before = spark.conf.get(FREED)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


class Scratch:
    """Intermediate tables, written in the shared folder as Parquet (a fraction of a checkpoint's bytes) and removed together when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, "scratch")
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def crc_of(column: str):
    """crc32 of an id as text, which deals rows into folds."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def carried(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """`__row` (a struct of the kept columns) and `__text` (the text's UTF-8 bytes) for a Python stage."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    return docs.select(row.alias(ROW), F.col(f"`{text}`").cast("binary").alias("__text"))


def groups(texts: list[bytes | None], most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive documents of about `most` bytes; a longer document is a range of its own."""
    start = held = 0
    for i, x in enumerate(texts):
        n = len(x) if x else 0
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def with_columns(batch: pa.RecordBatch, drop: set[str], added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch without the dropped columns, then the added ones."""
    kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n not in drop]
    names = [n for n, _ in kept] + list(added)
    return pa.RecordBatch.from_arrays([a for _, a in kept] + list(added.values()), names=names)
