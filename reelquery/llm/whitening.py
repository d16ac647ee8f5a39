"""Embedding whitening by hierarchical SVD merging.

A partition of the fit list keeps, block by block, its number of rows, its mean and the matrix R = diag(s) V^T of all its
singular values and right singular vectors: everything a covariance needs. Two summaries merge by stacking their R and one more
row, sqrt(n1 n2 / (n1 + n2)) (m1 - m2), which corrects for the different means, and taking the SVD of the stack. No
dimension is ever left out, and a covariance matrix is never formed, so small eigenvalues keep their digits. Summaries merge
in a tree: `FAN` partitions a task, level by level, at most dim x dim numbers each. The driver gets the last summary only.

The fit list is each distinct vector once, so a vector that a third of the rows share counts once and is aggregated
before it is shuffled. Sums are whole numbers and exact.

Defined results: vectors that are null, empty or hold null or non-finite entries give no rows; vectors of different
dimensions are whitened apart, each dimension with its own fit list; a vector of d < `most` entries has d components; where
an eigenvalue is 0 (up to rounding) `whitened` is null and the identity leaves that component out (its error is null if none is left), and
where all are, `explained` is null; `deviation` is null beyond 64 bits; repeated and null ids are rows like any other; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.llm.common import Scratch

#: Rows that a block of a partition takes to its SVD at once, and summaries that a task merges.
BLOCK, FAN = 4096, 8
_SUMMARY = "dim int, node bigint, n bigint, sums array<bigint>, mean array<double>, r array<double>"


class Summary:
    """Number, exact sums, mean, and R with R^T R = the sum of squares and products about the mean."""

    def __init__(self, n: int, sums: np.ndarray, mean: np.ndarray, r: np.ndarray):
        self.n, self.sums, self.mean, self.r = n, sums, mean, r

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """Of whole-number rows."""
        sums = x.sum(0)
        mean = sums / len(x)
        return cls(len(x), sums, mean, reduced(x - mean))

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        step = np.sqrt(self.n * (other.n / n)) * (self.mean - other.mean)
        sums = self.sums + other.sums
        return Summary(n, sums, sums / n, reduced(np.vstack([self.r, other.r, step[None, :]])))


def reduced(rows: np.ndarray) -> np.ndarray:
    """diag(s) V^T of all singular values of the rows: at most as many rows as columns, with the same R^T R."""
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _rows(found: dict[tuple[int, int], Summary]) -> pa.RecordBatch:
    keys = list(found)
    own = list(found.values())
    arrays = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array([s.n for s in own], pa.int64()), pa.array([s.sums for s in own], pa.list_(pa.int64())), pa.array([s.mean for s in own], pa.list_(pa.float64())), pa.array([s.r.ravel() for s in own], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(arrays, names=["dim", "node", "n", "sums", "mean", "r"])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary for each dimension of a partition."""
    found: dict[tuple[int, int], Summary] = {}
    for batch in batches:
        for d, rows in _by_dimension(batch.column(1)):
            for at in range(0, len(rows), BLOCK):
                own = Summary.of(_matrix(batch.column(1).take(pa.array(rows[at : at + BLOCK])), np.int64))
                key = d, batch.column(0)[0].as_py()
                found[key] = found[key].merged(own) if key in found else own
    if found:
        yield _rows(found)


def _by_dimension(column: pa.Array) -> list[tuple[int, np.ndarray]]:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return [(int(d), np.flatnonzero(sizes == d)) for d in np.unique(sizes)]


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    d, node = key[0].as_py(), key[1].as_py()
    out = None
    for r in sorted(rows, key=lambda r: r["node"]):
        s = Summary(r["n"], np.array(r["sums"], np.int64), np.array(r["mean"]), np.array(r["r"]).reshape(-1, d))
        out = s if out is None else out.merged(s)
    return pa.Table.from_batches([_rows({(d, node): out})])


def fitted(fit: DataFrame) -> dict[int, Summary]:
    """The summary of each dimension of the distinct vectors in column x."""
    parts = (fit.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1
    own = fit.select(F.spark_partition_id().cast("bigint").alias("node"), "x").mapInArrow(_summaries, _SUMMARY)
    while parts > FAN:
        own = own.groupBy("dim", F.expr(f"node div {FAN}").alias("up")).applyInArrow(_merge, _SUMMARY)
        parts = -(-parts // FAN)
    last = own.groupBy("dim", F.lit(0).cast("bigint").alias("up")).applyInArrow(_merge, _SUMMARY)
    return {r["dim"]: Summary(r["n"], np.array(r["sums"], np.int64), np.array(r["mean"]), np.array(r["r"]).reshape(-1, r["dim"])) for r in last.collect()}  # one row a dimension


class Whitening:
    """What projects a vector of one dimension: sums, n, directions scaled by the square roots of their eigenvalues, shares."""

    def __init__(self, fit: Summary, most: int):
        d = len(fit.mean)
        _, s, vt = np.linalg.svd(fit.r, full_matrices=True)
        s = np.concatenate([s, np.zeros(d - len(s))])
        e = s**2 / fit.n
        k = min(most, d)
        good = (s[:k] > s[0] * d * np.finfo(float).eps) & (s[:k] > 0)
        self.n, self.sums, self.mean = fit.n, fit.sums, fit.mean
        self.scaled = np.where(good[:, None], vt[:k] / np.sqrt(np.where(good, e[:k], 1))[:, None], np.nan)
        self.explained = e[:k] / e.sum() if e.sum() > 0 else np.full(k, np.nan)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.scaled.T

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum of (n x - S)^2, exact; null beyond 64 bits."""
        far = max(abs(int(x.max())), abs(int(x.min()))) * self.n + int(np.abs(self.sums).max())
        if len(self.mean) * far**2 < 1 << 63:
            return pa.array(((self.n * x - self.sums) ** 2).sum(1))
        exact = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums.tolist(), strict=True)) for row in x.tolist()]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def _projected(shared):
    """vec_id, component, n, deviation, whitened, explained."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows in _by_dimension(batch.column(1)):
                w = shared.value[d]
                for at in range(0, len(rows), BLOCK):
                    part = batch.take(pa.array(rows[at : at + BLOCK]))
                    x = _matrix(part.column(1), np.int64)
                    k = len(w.explained)
                    which = pa.array(np.repeat(np.arange(len(x)), k))
                    y = w.project(x).ravel()
                    share = np.tile(w.explained, len(x))
                    arrays = [part.column(0).take(which), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(y), w.n)), w.deviation(x).take(which), pa.array(y, mask=np.isnan(y)), pa.array(share, mask=np.isnan(share)), pa.array(np.full(len(y), d, np.int32))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "dim"])

    return run


def _axes(shared, most: int):
    """dim and c1, c2, ...: the whitened components of each row side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows in _by_dimension(batch.column(0)):
                for at in range(0, len(rows), BLOCK):
                    y = shared.value[d].project(_matrix(batch.column(0).take(pa.array(rows[at : at + BLOCK])), np.int64))
                    y = np.hstack([y, np.full((len(y), most - y.shape[1]), np.nan)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), d, np.int32)), *[pa.array(c, mask=np.isnan(c)) for c in y.T]], names=["dim", *[f"c{i}" for i in range(most)]])

    return run


def whiten(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, most: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: up to `most` rows for each usable vector, whose entries become floor(scale * entry)."""
    spark = vectors.sparkSession
    v = F.col(f"`{vector}`").cast("array<double>")
    good = (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.coalesce(good, F.lit(False))).select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.transform(v, lambda c: F.floor(scale * c).cast("bigint")).alias("x"))
    scratch = Scratch(spark)
    fit = scratch.keep(rows.select("x").distinct())
    model = {d: Whitening(s, most) for d, s in fitted(fit).items()}
    shared = spark.sparkContext.broadcast(model)  # `most` x dim numbers a dimension
    axes = fit.mapInArrow(_axes(shared, most), "dim int, " + ", ".join(f"c{i} double" for i in range(most)))
    pairs = [(i, j) for i in range(most) for j in range(i + 1)]
    # Covariances about the mean, added up by Spark from partial ones.
    covs = axes.groupBy("dim").agg(*[F.covar_pop(f"c{i}", f"c{j}").alias(f"c{i}_{j}") for i, j in pairs])
    errors = {r["dim"]: max((abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if r[f"c{i}_{j}"] is not None), default=None) for r in covs.collect()}  # one row a dimension
    scratch.drop()
    out = rows.mapInArrow(_projected(shared), "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, dim int")
    error = F.create_map(*[F.lit(x) for d, e in errors.items() for x in (d, e)]) if errors else F.create_map(F.lit(0), F.lit(0.0))
    return out.withColumn("identity_error", error[F.col("dim")].cast("double")).drop("dim")


def op13(vectors: DataFrame) -> DataFrame:
    return whiten(vectors, scale=256, most=4)
