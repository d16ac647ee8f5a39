"""Building and checking corpus and query tables; counting why rows were left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelquery.functions.parse import filled
from reelquery.functions.temporal import clipped_segment, finite
from reelquery.operators.order import running


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails (each is a condition for failing); `ok` if none does."""
    out = F.lit("ok")
    for name, failed in reversed(checks):
        out = F.when(F.coalesce(failed, F.lit(False)), name).otherwise(out)
    return out


def skip_counts(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """reason, n: how many rows each first failing check stops."""
    return df.groupBy(first_reason(checks).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def segments(df: DataFrame, start: str, end: str, duration: str) -> DataFrame:
    """The valid segments, with the end cut to the duration."""
    seg = clipped_segment(F.col(start), F.col(end), F.col(duration))
    return df.withColumn("__s", seg).where("__s is not null").withColumn(end, F.col("__s.end")).drop("__s")


def unique_qids(df: DataFrame, qid: str, line: str) -> DataFrame:
    """Repeated query ids get the line number as a suffix, once and unchecked: only the first keeps its id."""
    w = Window.partitionBy(qid).orderBy(line)
    rn = F.row_number().over(w)
    return df.withColumn("__rn", rn).withColumn(qid, F.when(F.col("__rn") > 1, F.concat_ws("_", qid, F.col(line).cast("string"))).otherwise(F.col(qid))).drop("__rn")


def usable_queries(queries: DataFrame, corpus: DataFrame, query: str, pos: str, doc: str, exclude_missing: bool = True) -> DataFrame:
    """Queries with text and a positive; with exclude_missing, one that the corpus has."""
    ok = queries.where((filled(F.col(query)) != "") & (filled(F.col(pos)) != ""))
    return ok.join(corpus.select(F.col(doc).alias(pos)).distinct(), pos, "left_semi") if exclude_missing else ok


def toy_row(ids: list[Column], start: Column, end: Column, duration: Column) -> Column:
    """Whether all ids are filled, the duration is above 0 and 0 <= start < end."""
    ok = finite(start) & finite(end) & (duration > 0) & (start >= 0) & (end > start)
    for i in ids:
        ok &= filled(i) != ""
    return F.coalesce(ok, F.lit(False))


def is_negative(response: Column, gold: Column, labels: tuple[str, ...] = ("neg", "negative", "not_matched")) -> Column:
    """Whether a sample is a negative one: its response says so, or its gold label does."""
    return F.coalesce(response.contains("<answer>not_matched</answer>"), F.lit(False)) | F.coalesce(F.lower(F.trim(gold)).isin(*labels), F.lit(False))


def finished(df: DataFrame, reason: str, exclude: str) -> DataFrame:
    """Rows whose finish reason isn't in the comma-separated list; blank reasons stay."""
    names = [x.strip().lower() for x in exclude.split(",") if x.strip()]
    r = F.lower(F.trim(F.coalesce(F.col(reason), F.lit(""))))
    return df.where((r == "") | ~r.isin(*names)) if names else df


def presence_chain(json: Column, keys: list[str]) -> Column:
    """The value of the first key that is present in a JSON object, as text: a null that is present counts (as the text null), unlike in a chain of coalesce."""
    have = F.json_object_keys(json)
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(F.array_contains(have, k), F.coalesce(F.get_json_object(json, f"$.{k}"), F.lit("null"))).otherwise(out)
    return out


def loader_stats(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """One row: total, valid, and a column for each check."""
    reason = first_reason(checks)
    return df.select(reason.alias("r")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("r") == "ok").alias("valid"), *[F.count_if(F.col("r") == name).alias(name) for name, _ in checks])


def within_bytes(df: DataFrame, size: str, ord: str, cap: int) -> DataFrame:
    """Rows of a dump until the bytes before a row reach the cap (checked before each row)."""
    out = running(df, [ord], sums={"__upto": size})
    return out.where(F.col("__upto") - F.coalesce(F.col(size), F.lit(0)) < cap).drop("__upto")
