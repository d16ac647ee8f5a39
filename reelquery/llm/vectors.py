"""Embedding near-duplicates by an exact metric range join.

Vectors are scaled to length 1 in double precision; a cosine of at least `cosine` is a distance of at most
eps = sqrt(2 - 2 cosine). Pivots (a bounded sample of the vectors) split the space into cells: each vector is at home
with its nearest pivot. If x lives with p and y with q, and d(x, y) <= eps, the triangle inequality gives
d(x, q) - d(x, p) <= 2 eps, and the hyperplane between the pivots gives (d(x,q)^2 - d(x,p)^2) / (2 d(p,q)) <= eps;
a vector is replicated into a cell of smaller number only if both bounds allow a partner there. Each pair is then
compared once, in the cell of the smaller number of its two homes, and cells join independently. What the bounds
leave out cannot be linked, so no link is lost; a tolerance of 1e-9 covers rounding.

Equal vectors are one class with a weight; a class links to itself as often as it has copies. Large cells are split
into blocks of about `BLOCK` vectors at home and `REPLICAS` replicas; a task is a pair of blocks of which one is at home
(replicas need not meet), so no task holds an unbounded group. More pivots would not save comparisons where vectors
fill the space evenly, but copy each into more cells.

Scale: pivots are a sample of at most `MOST_PIVOTS` vectors of each dimension (the only thing that is broadcast, 8 bytes a component);
a task returns counts and a spanning forest of its links, never all links.

Defined results: vectors that are null or zero, or hold null or non-finite components, link with nothing and are their
own component; vectors link with those of their own dimension only; rows that share an id are one node, whose
links count from each row; a null id links with nothing and has a null component and is kept; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelquery.llm.common import cut
from reelquery.llm.components import components, spread_join

#: One pivot for so many vectors, 8 at least and MOST_PIVOTS at most; vectors of a block at home, and of one of replicas.
PER_PIVOT, MOST_PIVOTS, BLOCK, REPLICAS = 2048, 2048, 2048, 8192


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; the largest component is scaled to 1 first, so no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True, initial=0)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _assign(shared, eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = {}
        for d, (pivots, _) in shared.value.items():
            gaps[d] = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
            np.fill_diagonal(gaps[d], 1)
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for d, rows in ((d, np.flatnonzero(sizes == d)) for d in np.unique(sizes).tolist()):
                pivots, first = shared.value[d]
                gap = gaps[d]
                for at in range(0, len(rows), 1024):
                    part = batch.take(pa.array(rows[at : at + 1024]))
                    x = unit(_matrix(part.column(1)))
                    d2 = np.maximum(0, 2 - 2 * x @ pivots.T)
                    home = d2.argmin(1)
                    own = d2[np.arange(len(x)), home]
                    far = np.sqrt(d2)
                    near = far - np.sqrt(own)[:, None] <= 2 * eps + 1e-9
                    near &= (d2 - own[:, None]) / (2 * np.maximum(gap[home], 1e-12)) <= eps + 1e-9
                    near &= np.arange(len(pivots))[None, :] <= home[:, None]
                    near[np.arange(len(x)), home] = True
                    row, cell = np.nonzero(near)
                    yield pa.RecordBatch.from_arrays([pa.array((first + cell).astype(np.int32)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), part.column(2).take(pa.array(row)), pa.array(home[row] == cell)], names=["cell", "id", "v", "w", "home"])

    return run


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, label) that connect what the links (a, b) connect, at most one for each i."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        label = label[label]
        if np.array_equal(label, before):
            break
    i = np.flatnonzero(label != np.arange(n))
    return i, label[i]


def _join_blocks(cosine: float):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x = unit(_matrix(group.column("v").chunk(0) if group.num_rows else group.column("v")))
        ids = group.column("id").to_numpy()
        w = group.column("w").to_numpy()
        home = group.column("home").to_numpy(zero_copy_only=False)
        block = group.column("block").to_numpy()
        first, second = key[1].as_py(), key[2].as_py()
        left = np.flatnonzero(home & (block == first))
        right = np.flatnonzero(~home) if second < 0 else left if first == second else np.flatnonzero(home & (block == second))
        count = np.zeros(len(ids), np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            good = x[rows] @ x[right].T >= cosine
            if first == second:
                good &= rows[:, None] < right[None, :]
            i, j = np.nonzero(good)
            i, j = rows[i], right[j]
            np.add.at(count, i, w[j])
            np.add.at(count, j, w[i])
            if len(i):
                ends.append(_forest_of(i, j))
        a = np.concatenate([e[0] for e in ends]) if ends else np.zeros(0, np.int64)
        b = np.concatenate([e[1] for e in ends]) if ends else np.zeros(0, np.int64)
        some = np.flatnonzero(count)
        return pa.table({"id": pa.array(np.concatenate([ids[some], ids[a]])), "other": pa.array([None] * len(some) + ids[b].tolist(), pa.int64()), "links": pa.array(np.concatenate([count[some], np.zeros(len(a), np.int64)]))})

    return run


def _forest_of(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, which = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = _forest(len(nodes), which[: len(i)], which[len(i) :])
    return nodes[a], nodes[b]


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """One row per input row: id, n_links (other rows linked directly), component (the smallest id reachable by links)."""
    spark = vectors.sparkSession
    kind = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"  # as stored; compared in double
    v = F.col(f"`{vector}`").cast(f"array<{kind}>")
    good = F.size(v) > 0
    good &= ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.when(good, v).alias("v"))
    usable = rows.where("id is not null and v is not null")
    # Adding 0.0 makes -0.0 and 0.0 equal before they are compared as keys.
    usable = usable.select("id", F.transform("v", lambda x: x + F.lit(0.0).cast(kind)).alias("v"))
    usable = usable.withColumn("vkey", F.xxhash64("v"))
    classes = cut(usable.groupBy("vkey", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")))
    pivots = _pivots(classes)
    if not pivots:
        return rows.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    eps = float(np.sqrt(2 - 2 * cosine))
    dealt = classes.select("id", "v", "w").mapInArrow(_assign(spark.sparkContext.broadcast(pivots), eps), f"cell int, id bigint, v array<{kind}>, w bigint, home boolean")
    dealt = cut(dealt)
    sizes = {(r[0], r[1]): r[2] for r in dealt.groupBy("cell", "home").count().collect()}  # two rows for each pivot at most
    blocks = {c: (-(-sizes.get((c, True), 0) // BLOCK), -(-sizes.get((c, False), 0) // REPLICAS)) for c, _ in sizes}
    of_cell = [F.create_map(*[F.lit(x) for c, n in blocks.items() for x in (c, n[k])])[F.col("cell")] for k in (0, 1)]
    own = F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("hb")).otherwise(F.col("rb"))).cast("int")
    blocked = dealt.withColumn("hb", of_cell[0]).withColumn("rb", of_cell[1]).where("hb > 0").withColumn("block", own)
    homes = F.sequence(F.lit(0), F.col("hb") - 1)
    inside = F.transform(homes, lambda i: F.struct(F.least(F.col("block"), i).alias("x"), F.greatest(F.col("block"), i).alias("y")))
    across = F.when(F.col("rb") > 0, F.transform(F.sequence(F.lit(1), F.greatest("rb", F.lit(1))), lambda k: F.struct(F.col("block").alias("x"), (-k).alias("y")))).otherwise(F.array().cast("array<struct<x:int,y:int>>"))
    visits = F.transform(homes, lambda i: F.struct(i.alias("x"), (-1 - F.col("block")).alias("y")))
    tasks = F.when(F.col("home"), F.concat(inside, across)).otherwise(visits)
    pairs = blocked.withColumn("task", F.explode(tasks)).select("cell", "task.x", "task.y", "id", "v", "w", "home", "block")
    found = cut(pairs.groupBy("cell", "x", "y").applyInArrow(_join_blocks(cosine), "id bigint, other bigint, links bigint"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    of_class = classes.select("id", "w").join(links, "id", "left").join(comp.select(F.col("node").alias("id"), "comp"), "id", "left")
    of_class = of_class.select(F.col("id").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("comp", "id").alias("comp"))
    member = spread_join(usable.select("id", "vkey", "v"), classes.select("vkey", F.col("v").alias("cv"), F.col("id").alias("rep")), "vkey").where("v = cv").select("id", "rep")
    member = spread_join(member, of_class, "rep").groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("comp").alias("comp"))
    return spread_join(rows.select("id"), member, "id", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("comp", "id").alias("component"))


def _pivots(classes: DataFrame) -> dict[int, tuple[np.ndarray, int]]:
    """Of each dimension (there are few) its pivots and the number of its first cell."""
    total = {r[0]: r[1] for r in classes.groupBy(F.size("v").alias("d")).count().collect()}
    wanted = {d: int(min(MOST_PIVOTS, max(8, n // PER_PIVOT))) for d, n in total.items()}
    if not total:
        return {}
    # As many of the smallest hashes as the pool of a dimension may have; the rate keeps what is sorted small.
    rate = F.create_map(*[F.lit(x) for d, n in total.items() for x in (d, int(min(1.0, 16 * wanted[d] / n) * (1 << 30)))])
    at = F.pmod(F.xxhash64("vkey", F.lit(7)), F.lit(1 << 30))
    some = classes.where(at < rate[F.size("v")]).select(F.size("v").alias("d"), at.alias("at"), "v", "vkey")
    order = Window.partitionBy("d").orderBy("at", "vkey")
    most = F.create_map(*[F.lit(x) for d in total for x in (d, 8 * wanted[d])])
    pool: dict[int, list] = {d: [] for d in total}
    for d, v in some.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most[F.col("d")]).select("d", "v").collect():
        pool[d].append(v)
    out, first = {}, 0
    for d in sorted(total):
        own = pool[d] or [classes.where(F.size("v") == d).select("v").first()[0]]
        out[d] = spread_pivots(unit(np.array(own, np.float64)), wanted[d]), first
        first += len(out[d][0])
    return out


def spread_pivots(pool: np.ndarray, wanted: int) -> np.ndarray:
    """Pivots far from each other: the vector of the pool that is farthest from those chosen, again and again."""
    chosen = [0]
    far = pool @ pool[0]
    while len(chosen) < min(wanted, len(pool)):
        k = int(far.argmin())
        if far[k] > 1 - 1e-9:
            break
        chosen.append(k)
        far = np.maximum(far, pool @ pool[k])
    return pool[chosen]


def op10(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    found = near_duplicates(vectors, cosine=0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
