"""Lookup joins: first or last wins, fallback keys, bags, anti-joins for resuming, upserts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelquery.operators.order import numbered, one_per_key


def by_text(left: DataFrame, meta: DataFrame, key: str, ord: str, keep: str = "first", how: str = "inner") -> DataFrame:
    """Joins on a text key of which meta keeps the first or the last row."""
    return left.join(one_per_key(meta, [key], ord, keep).drop(ord), key, how)


def last_filled(meta: DataFrame, key: str, ord: str, values: list[str], always: list[str] = ()) -> DataFrame:
    """Per key, for each value the last one that isn't empty, and for `always` columns the last row's."""
    out = [F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col(ord))).alias(c) for c in values]
    out += [F.max_by(c, ord).alias(c) for c in always]
    return meta.groupBy(key).agg(*out)


def with_fallback(left: DataFrame, meta: DataFrame, keys: list[Column], key: str, value: str, name: str) -> DataFrame:
    """Adds `name`: the value that meta (one row per key) has for the first of the left side's key columns that it knows."""
    out, found = left, []
    for i, k in enumerate(keys):
        side = meta.select(F.col(key).alias(f"__k{i}"), F.col(value).alias(f"__v{i}"))
        out = out.withColumn(f"__l{i}", k).join(side, F.col(f"__l{i}") == F.col(f"__k{i}"), "left").drop(f"__l{i}", f"__k{i}")
        found.append(F.col(f"__v{i}"))
    return out.withColumn(name, F.coalesce(*found)).drop(*[f"__v{i}" for i in range(len(keys))])


def path_index(meta: DataFrame, path: str, ord: str, value: str) -> DataFrame:
    """key, value: each row under its path, its base name and its stem; the last row wins for each key."""
    from reelquery.functions.parse import base_name, stem

    p = F.col(path)
    each = meta.select(F.explode(F.array_distinct(F.array(p, base_name(p), stem(p)))).alias("key"), F.col(value).alias("value"), F.col(ord).alias("o"))
    return each.groupBy("key").agg(F.max_by("value", "o").alias("value"))


def best_extension(files: DataFrame, path: str, ord: str, priority: list[str]) -> DataFrame:
    """stem, path: of files that share a stem the one whose extension comes first in `priority`, then the first listed; other extensions are left out."""
    from reelquery.functions.parse import stem

    ext = F.lower(F.regexp_extract(F.col(path), r"(\.[^./]+)$", 1))
    rank = F.array_position(F.array(*[F.lit(x) for x in priority]), ext)
    ranked = files.select(stem(F.col(path)).alias("stem"), F.col(path).alias("path"), rank.alias("r"), F.col(ord).alias("o")).where("r > 0")
    return ranked.groupBy("stem").agg(F.min_by("path", F.struct("r", "o")).alias("path"))


def bag_match(requests: DataFrame, meta: DataFrame, query: str, pos: str, ord: str) -> DataFrame:
    """query, ord, meta_ord: requests matched to meta rows one to one, in order of the requests.

    A request with a pos takes the first free meta row of its (query, pos), one without the first free row of its query.
    Where the requests of a query all have a pos or all lack one, the n-th request takes the n-th row (a window join). Where
    they are mixed, who comes first decides, and the query's rows are folded in order; such a query's rows meet in a task, as
    two columns. Requests without a query match nothing.
    """
    some = requests.where(F.coalesce(F.col(query), F.lit("")) != "").select(query, F.coalesce(F.col(pos), F.lit("")).alias(pos), ord)
    known = meta.select(query, F.coalesce(F.col(pos), F.lit("")).alias(pos), F.col(ord).alias("meta_ord"))
    kinds = some.groupBy(query).agg(F.bool_or(F.col(pos) == "").alias("o"), F.bool_or(F.col(pos) != "").alias("p"))
    mixed = kinds.where("o and p").select(query)

    plain = some.join(mixed, query, "left_anti")
    pair = lambda df, o: df.withColumn("__n", F.row_number().over(Window.partitionBy(query, pos).orderBy(o)))
    paired = pair(plain.where(F.col(pos) != ""), ord).join(pair(known, "meta_ord"), [query, pos, "__n"]).select(query, ord, "meta_ord")
    line = lambda df, o: df.withColumn("__n", F.row_number().over(Window.partitionBy(query).orderBy(o)))
    open_ = line(plain.where(F.col(pos) == ""), ord).join(line(known, "meta_ord").drop(pos), [query, "__n"]).select(query, ord, "meta_ord")

    left = some.join(mixed, query, "left_semi").select(query, F.col(pos).alias("pos"), F.col(ord).cast("bigint").alias("ord"))
    right = known.join(mixed, query, "left_semi").select(query, F.col(pos).alias("pos"), F.col("meta_ord").cast("bigint").alias("ord"))
    shape = f"`{query}` string, `{ord}` bigint, meta_ord bigint"
    folded = left.groupBy(query).cogroup(right.groupBy(query)).applyInArrow(_folded(query, ord), shape)
    return paired.unionByName(open_).unionByName(folded)


def _folded(query: str, ord: str):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.sort_by("ord")
        meta, at = rows.column("pos").to_pylist(), rows.column("ord").to_numpy()
        buckets: dict[str, list[int]] = {}
        for i, p in enumerate(meta):
            buckets.setdefault(p, []).append(i)
        next_of = dict.fromkeys(buckets, 0)
        used, front = bytearray(len(meta)), 0
        took: list[tuple[int, int]] = []
        asked = left.sort_by("ord")
        for p, o in zip(asked.column("pos").to_pylist(), asked.column("ord").to_pylist(), strict=True):
            own, i = (buckets.get(p, []), next_of.get(p, 0)) if p else (range(len(meta)), front)
            while i < len(own) and used[own[i]]:
                i += 1
            if i < len(own):
                used[own[i]] = 1
                took.append((o, own[i]))
                i += 1
            if p:
                next_of[p] = i
            else:
                front = i
        return pa.table({query: pa.array([key[0].as_py()] * len(took), pa.string()), ord: pa.array([o for o, _ in took], pa.int64()), "meta_ord": pa.array([int(at[i]) for _, i in took], pa.int64())})

    return run


def bag_skips(requests: DataFrame, matched: DataFrame, query: str, pos: str, ord: str) -> DataFrame:
    """reason, n of the requests that bag_match left out: query_empty, query_pair_not_found_in_meta, query_not_found_in_meta."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    out = requests.join(matched.select(ord), ord, "left_anti")
    return out.groupBy(F.when(blank(query), "query_empty").when(blank(pos), "query_not_found_in_meta").otherwise("query_pair_not_found_in_meta").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't done yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def members(df: DataFrame, *keeps: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in any of the other tables."""
    every = keeps[0].select(key)
    for k in keeps[1:]:
        every = every.union(k.select(key))
    return df.join(every.distinct(), key, "left_semi")


def missing(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """The distinct required keys that aren't present."""
    return required.select(key).where(F.col(key).isNotNull()).distinct().join(present.select(key), key, "left_anti")


def reused(df: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """The value of `known` where it has the key, else the row's own; column `was_reused` tells which."""
    k = known.select(key, F.col(value).alias("__known"))
    return df.join(k, key, "left").withColumn("was_reused", F.col("__known").isNotNull()).withColumn(value, F.coalesce("__known", value)).drop("__known")


def upsert(base: DataFrame, patch: DataFrame, key: str, value: str, row: str) -> DataFrame:
    """Replaces the values of known keys in place and appends new keys with the rows after the last."""
    last = base.agg(F.coalesce(F.max(row), F.lit(-1)).alias("__last"))
    p = patch.select(key, F.col(value).alias("__new"))
    kept = base.join(p, key, "left").select(key, F.coalesce("__new", value).alias(value), row)
    new = p.join(base.select(key), key, "left_anti")
    new = numbered(new, [key], "__place", start=1).crossJoin(F.broadcast(last)).select(key, F.col("__new").alias(value), (F.col("__last") + F.col("__place")).alias(row))
    return kept.unionByName(new)


def append_absent(meta: DataFrame, extra: DataFrame, recovered: DataFrame, key: str, ord: str) -> DataFrame:
    """meta, then of `extra` the first row of each recovered key that meta lacks."""
    new = one_per_key(extra.join(recovered.select(key).distinct(), key, "left_semi").join(meta.select(key), key, "left_anti"), [key], ord)
    return meta.unionByName(new)


def by_row(ids: DataFrame, key: str, row: str) -> DataFrame:
    """row, key for every row from 0 to the larger of the count and the last row; gaps have an empty key."""
    last = ids.agg(F.greatest(F.count(F.lit(1)), F.coalesce(F.max(row) + 1, F.lit(0))).alias("n")).first()[0]
    every = ids.sparkSession.range(last).select(F.col("id").alias(row))
    return every.join(ids.groupBy(row).agg(F.max(key).alias(key)), row, "left").select(row, F.coalesce(key, F.lit("")).alias(key))
