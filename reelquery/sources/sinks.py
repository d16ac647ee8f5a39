"""Writers: JSON lines that keep nulls, files that appear whole, summaries, leaderboards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.operators.report import markdown
from reelquery.sources.snapshots import Table


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of JSON lines, in UTF-8, with null fields written as null."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def replace_whole(df: DataFrame, path: str) -> int:
    """Replaces all rows of a snapshot table and returns its version: readers (`read_whole`) see the old rows or the new ones, never neither."""
    return Table(df.sparkSession, path).replace(df)


def read_whole(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows that stand in a snapshot table."""
    return Table(spark, path).read(version)


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its target, then moves it over the target in one step."""
    fs = spark._jvm.org.apache.hadoop.fs
    target, beside = fs.Path(path), fs.Path(f"{path}.tmp-{uuid.uuid4().hex}")
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration()).rename(store.makeQualified(beside), store.makeQualified(target), over)


def write_summary(df: DataFrame, path: str) -> None:
    """One JSON object of a one-row result."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_leaderboard(df: DataFrame, path: str) -> str:
    """CSV and JSON below a folder; returns the same table as Markdown. Leaderboards have a row a checkpoint."""
    df.coalesce(1).write.mode("overwrite").csv(f"{path}/csv", header=True)
    df.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    return markdown(df)


def upsert_block(text: str, name: str, block: str) -> str:
    """A YAML text in which the top-level block `name` is replaced, or appended if it isn't there (driver side, no data)."""
    out, inside, done = [], False, False
    new = block.rstrip("\n").split("\n")
    for line in text.split("\n"):
        top = line[:1] not in ("", " ", "\t", "#", "-")
        if top:
            inside = line.split(":")[0].strip() == name
            if inside and not done:
                out += new
                done = True
        if not inside:
            out.append(line)
    if not done:
        out = [*"\n".join(out).rstrip("\n").split("\n"), *new] if "\n".join(out).strip() else new
    return "\n".join(out).rstrip("\n") + "\n"


def with_nulls(df: DataFrame) -> DataFrame:
    """One column `value`: each row as JSON with its nulls."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
