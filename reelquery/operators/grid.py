"""Exact retrieval as a grid join: blocks of queries meet blocks of the corpus as two keyed tables.

Each vector goes to one block by a hash; a block of queries is sent to every block of the corpus and the other way round, so
that a task holds one pair of blocks of bounded size and scores it by a matrix product. Of a pair only the k best of each
query leave the task, and these are merged `FAN` blocks at a time, level by level. Ranks need no list at all: a pair of
blocks counts what scores above the query's positive, and the counts are added up. Where the rank of every pair is wanted,
a task holds the scores of a few queries while the corpus, written once, is streamed past it (`beyond`).

Nothing goes through the driver but counts; nothing is broadcast; a pair of vectors is a row only where the result has it.

Scores are exact: the product only selects, with a bound on its rounding error, what is then scored in the order in which
the SQL expression adds up. So results equal those of `retrieval.scores` bit by bit, ties included.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of vectors in a block of queries and of the corpus (as doubles), rows of a product at once, blocks merged by a task.
QUERY_BYTES, CORPUS_BYTES, ROWS, FAN = 8 << 20, 32 << 20, 128, 8
#: Pairs that are scored exactly at once; queries and docs of a pair of blocks whose pairs all become rows.
EXACT, PAIR_QUERIES, PAIR_DOCS = 1 << 16, 512, 8192
#: Pairs whose scores a task holds to rank them, about; bytes of vectors in a packed row of the corpus; rows of a batch of ranks.
HELD, PACK_BYTES, RANKS = 1 << 24, 2 << 20, 1 << 16


@dataclass(frozen=True)
class Change:
    """Another score of a pair: its score rounded half up, as in SQL, times a factor of the doc (a function of an array of ids)."""

    digits: int
    factor: Callable[[np.ndarray], np.ndarray]

    def of(self, score: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return half_up(score, self.digits) * self.factor(doc)

    def error(self, slack: np.ndarray) -> np.ndarray:
        """By how much the rounded score may differ from one that is off by the slack."""
        return slack + 0.6 * 10.0**-self.digits


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Doubles rounded half away from zero as decimals: x goes up from the double nearest to the half on, as both orders agree."""
    unit, size = 10.0**digits, np.abs(x)
    low = np.floor(size * unit)
    low += (size >= (2 * low + 1) / (2 * unit)).astype(float) - (size < (2 * low - 1) / (2 * unit))
    return np.copysign(low / unit, x)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up from the first entry to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The inner products of the pairs (i, j), some at a time, however many they are."""
    return np.concatenate([np.zeros(0), *[_dots(q[i[at : at + EXACT]], x[j[at : at + EXACT]]) for at in range(0, len(i), EXACT)]])


def _slack(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """By how much a product and the sum in order can differ at most, for each query."""
    most = np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0))
    return 4 * (q.shape[1] + 2) * np.finfo(float).eps * np.sqrt(np.einsum("ij,ij->i", q, q)) * most


def _first_k(group: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group: highest score, then smallest doc."""
    order = np.lexsort((doc, -score, group))
    starts = np.r_[True, group[order][1:] != group[order][:-1]]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    return order[place < k]


def _best(k: int, self_match: bool, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [], [], []
        if left.num_rows and right.num_rows:
            qid, q = left.column("qid").to_numpy(), _vectors(left.column("qvec"))
            doc, x = right.column("doc").to_numpy(), _vectors(right.column("dvec"))
            slack = _slack(q, x)
            for at in range(0, len(q), ROWS):
                s = q[at : at + ROWS] @ x.T
                if not self_match:
                    s[qid[at : at + ROWS, None] == doc[None, :]] = -np.inf
                if allowed is not None:
                    s[~allowed(qid[at : at + ROWS, None], doc[None, :])] = -np.inf
                least = np.partition(s, len(doc) - k, axis=1)[:, len(doc) - k] if len(doc) > k else np.full(len(s), -np.inf)
                i, j = np.nonzero((s >= (least - 2 * slack[at : at + ROWS])[:, None]) & (s > -np.inf))
                score = _exact(q, x, at + i, j)
                kept = _first_k(i, score, doc[j], k)
                for part, values in zip(parts, (qid[at + i[kept]], doc[j[kept]], score[kept]), strict=True):
                    part.append(values)
        return _hits(key, *(np.concatenate(p) if p else np.zeros(0) for p in parts))

    return run


def _hits(key: tuple, qid: np.ndarray, doc: np.ndarray, score: np.ndarray) -> pa.Table:
    n = len(qid)
    return pa.table({"qb": pa.array([key[0].as_py()] * n, pa.int32()), "cb": pa.array([key[1].as_py()] * n, pa.int32()), "qid": pa.array(qid.astype(np.int64)), "doc": pa.array(doc.astype(np.int64)), "score": pa.array(score.astype(np.float64))})


def _merge(k: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        qid, doc, score = (table.column(n).to_numpy() for n in ("qid", "doc", "score"))
        kept = _first_k(qid, score, doc, k)
        return _hits(key, qid[kept], doc[kept], score[kept])

    return run


def _below(k: int, change: Change, self_match: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The k best by the changed score of those whose rounded score is below the query's limit."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [], [], []
        if left.num_rows and right.num_rows:
            qid, q = left.column("qid").to_numpy(), _vectors(left.column("qvec"))
            doc, x = right.column("doc").to_numpy(), _vectors(right.column("dvec"))
            limit, error, factor = left.column("below").to_numpy(), change.error(_slack(q, x)), change.factor(doc)
            most = np.abs(factor).max()
            for at in range(0, len(q), ROWS):
                own = slice(at, at + ROWS)
                s, e = q[own] @ x.T, error[own, None]
                may = s - e < limit[own, None]
                if not self_match:
                    may &= qid[own, None] != doc[None, :]
                new = s * factor[None, :]
                sure = np.where(may & (s + e < limit[own, None]), new, -np.inf)
                least = np.partition(sure, len(doc) - k, axis=1)[:, len(doc) - k] if len(doc) > k else np.full(len(s), -np.inf)
                i, j = np.nonzero(may & (new >= (least[:, None] - 2 * e * most)))
                score = _exact(q, x, at + i, j)
                met = half_up(score, change.digits) < limit[at + i]
                i, j, score = i[met], j[met], change.of(score[met], doc[j[met]])
                kept = _first_k(i, score, doc[j], k)
                for part, values in zip(parts, (qid[at + i[kept]], doc[j[kept]], score[kept]), strict=True):
                    part.append(values)
        return _hits(key, *(np.concatenate(p) if p else np.zeros(0) for p in parts))

    return run


def _above(self_match: bool, change: Change | None = None) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        qid, n = left.column("qid").to_numpy(), np.zeros(left.num_rows, np.int64)
        if left.num_rows and right.num_rows:
            q, x, doc = _vectors(left.column("qvec")), _vectors(right.column("dvec")), right.column("doc").to_numpy()
            own, slack = left.column("own_score").to_numpy(), _slack(q, x)
            if change:
                factor = change.factor(doc)
                slack = change.error(slack) * np.abs(factor).max()
            for at in range(0, len(q), ROWS):
                s = q[at : at + ROWS] @ x.T
                over = (s * factor[None, :] if change else s) - own[at : at + ROWS, None]
                sure = over > slack[at : at + ROWS, None]
                i, j = np.nonzero(np.abs(over) <= slack[at : at + ROWS, None])
                score = _exact(q, x, at + i, j)
                sure[i, j] = (change.of(score, doc[j]) if change else score) > own[at + i]
                if not self_match:
                    sure &= qid[at : at + ROWS, None] != doc[None, :]
                n[at : at + ROWS] = sure.sum(1)
        return pa.table({"qid": pa.array(qid.astype(np.int64)), "above": pa.array(n)})

    return run


def _in_order(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The inner products of all pairs, added up from the first entry to the last."""
    score, x = np.zeros((len(q), len(x))), np.ascontiguousarray(x.T)
    for i in range(len(q)):
        for j in range(len(x)):
            score[i] += q[i, j] * x[j]
    return score


def _all(self_match: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        qid, doc = left.column("qid").to_numpy().astype(np.int64), right.column("doc").to_numpy().astype(np.int64)
        score = np.zeros((len(qid), len(doc)))
        if score.size:
            score = _in_order(_vectors(left.column("qvec")), _vectors(right.column("dvec")))
        kept = np.ones(score.shape, np.bool_) if self_match else qid[:, None] != doc[None, :]
        i, j = np.nonzero(kept)
        return pa.table({"qid": pa.array(qid[i]), "doc": pa.array(doc[j]), "score": pa.array(score[kept])})

    return run


def _packed(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of many docs and their vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                doc, x = batch.column("doc").to_numpy(), _vectors(pa.chunked_array([batch.column("dvec")])).astype(kind)
                step = max(1, PACK_BYTES // max(x[0].nbytes, 1))
                for at in range(0, len(doc), step):
                    yield pa.RecordBatch.from_pydict({"docs": [doc[at : at + step].tobytes()], "dvecs": [x[at : at + step].tobytes()]})

    return run


def _packed_queries(key: tuple, table: pa.Table) -> pa.Table:
    return pa.table({"qb": pa.array([key[0].as_py()], pa.int32()), "qids": [table.column("qid").to_numpy().tobytes()], "qvecs": [_vectors(table.column("qvec")).tobytes()]})


def _beyond(k: int, self_match: bool, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One block of queries, which is in every row, ranks the docs of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid = q = None
        docs, scores, waiting = [], [], []

        def score() -> None:
            doc = np.concatenate([d for d, _ in waiting])
            docs.append(doc)
            scores.append(_in_order(q, np.concatenate([x for _, x in waiting]).reshape(len(doc), -1).astype(np.float64)))
            waiting.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                at = lambda name, of: np.frombuffer(batch.column(name)[row].as_buffer(), of)  # noqa: B023, E731
                if qid is None:
                    qid = at("qids", np.int64).copy()
                    q = at("qvecs", np.float64).reshape(len(qid), -1).copy()
                waiting.append((at("docs", np.int64), at("dvecs", kind)))
                if sum(len(d) for d, _ in waiting) >= PAIR_DOCS:
                    score()
        if waiting:
            score()
        all_docs = np.concatenate([np.zeros(0, np.int64), *docs])
        for own in [] if qid is None else np.unique(qid):
            rows = np.flatnonzero(qid == own)
            doc, s = np.tile(all_docs, len(rows)), np.concatenate([part[i] for i in rows for part in scores])
            if not self_match:
                doc, s = doc[doc != own], s[doc != own]
            order = np.argsort(-s)
            if (s[order[1:]] == s[order[:-1]]).any():
                order = np.lexsort((doc, -s))
            for at in range(k, len(order), RANKS):
                found = doc[order[at : at + RANKS]]
                yield pa.RecordBatch.from_pydict({"qid": np.full(len(found), own), "doc": found, "rank": np.arange(at + 1, at + 1 + len(found), dtype=np.int32)})

    return run


def sizes(queries: DataFrame, corpus: DataFrame) -> tuple[int, int]:
    """How many blocks queries and corpus are cut into: by bytes, and at least so many that all cores have a pair."""
    n, dim = queries.agg(F.count(F.lit(1)), F.max(F.size("qvec"))).first()
    m = corpus.count()
    width = 8 * max(dim or 1, 1)
    q = max(1, -(-n * width // QUERY_BYTES))
    c = max(1, -(-m * width // CORPUS_BYTES))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    return q, max(c, min(-(-cores // q), -(-m // 1024)))


def keyed(queries: DataFrame, corpus: DataFrame, blocks: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Both tables with qb and cb: queries once for each block of the corpus, the corpus once for each block of queries."""
    q, c = blocks
    block = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    left = queries.withColumn("qb", block(q, "qid", "qvec")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c - 1))))
    right = corpus.withColumn("cb", block(c, "doc", "dvec")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q - 1))))
    return left, right


def _sides(queries: DataFrame, corpus: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    q = queries.where("qid is not null and qvec is not null").select(F.col("qid").cast("bigint").alias("qid"), "qvec", *more)
    return q, corpus.where("doc is not null and dvec is not null").select(F.col("doc").cast("bigint").alias("doc"), "dvec")


def _merged(q: DataFrame, x: DataFrame, k: int, found_by: Callable[[tuple, pa.Table, pa.Table], pa.Table]) -> DataFrame:
    blocks = sizes(q, x)
    left, right = keyed(q, x, blocks)
    shape = "qb int, cb int, qid bigint, doc bigint, score double"
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(found_by, shape)
    n = blocks[1]
    while n > 1:
        found = found.groupBy("qb", F.expr(f"cb div {FAN}").cast("int").alias("up")).applyInArrow(_merge(k), shape)
        n = -(-n // FAN)
    return found.select("qid", "doc", "score")


def nearest(queries: DataFrame, corpus: DataFrame, k: int, self_match: bool = True, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """qid, doc, score of the k best of each query, equal scores by ascending doc; ids are bigint.

    Vectors are finite and of one length; null vectors meet nothing. With self_match=False, a doc of the query's own id is no match;
    with `allowed`, a function of an array of qids and one of docs, only pairs for which it is true are matches.
    """
    return _merged(*_sides(queries, corpus), k, _best(k, self_match, allowed))


def nearest_below(queries: DataFrame, corpus: DataFrame, k: int, change: Change, self_match: bool = True) -> DataFrame:
    """qid, doc, score of the k best of each query by the changed score, of the docs whose rounded score is less than the query's `below` (double); equal ones by ascending doc."""
    return _merged(*_sides(queries, corpus, "below"), k, _below(k, change, self_match))


def above(queries: DataFrame, corpus: DataFrame, self_match: bool = True, change: Change | None = None) -> DataFrame:
    """qid, above: how many docs score strictly higher than the query's `own_score` (double), by the changed score if there is one."""
    q, x = _sides(queries, corpus, "own_score")
    left, right = keyed(q, x, sizes(q, x))
    counted = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(_above(self_match, change), "qid bigint, above bigint")
    return counted.groupBy("qid").agg(F.sum("above").alias("above"))


def own_scores(queries: DataFrame, corpus: DataFrame, positives: DataFrame) -> DataFrame:
    """qid, qvec, own_score: the queries whose positive (qid, pos) is in the corpus, with its score; no other pair is scored."""
    from reelquery.functions.vector import dot

    x = corpus.where("doc is not null and dvec is not null").select(F.col("doc").cast("bigint").alias("doc"), "dvec")
    own = queries.join(positives.select("qid", F.col("pos").cast("bigint").alias("doc")), "qid").join(x, "doc")
    return own.select(F.col("qid").cast("bigint").alias("qid"), "qvec", dot(F.col("qvec"), F.col("dvec")).alias("own_score"))


def ranks(queries: DataFrame, corpus: DataFrame, positives: DataFrame, self_match: bool = True) -> DataFrame:
    """qid, rank: one more than the number of docs that score strictly higher than the query's positive (qid, pos); queries whose positive isn't in the corpus are left out."""
    counted = above(own_scores(queries, corpus, positives), corpus, self_match)
    return counted.select("qid", (F.col("above") + 1).cast("int").alias("rank"))


def pairs(queries: DataFrame, corpus: DataFrame, self_match: bool = True) -> DataFrame:
    """qid, doc, score of all pairs, where each is a row of the result: scored by blocks, `PAIR_QUERIES` by `PAIR_DOCS` about."""
    q, x = _sides(queries, corpus)
    blocks = max(1, -(-q.count() // PAIR_QUERIES)), max(1, -(-x.count() // PAIR_DOCS))
    left, right = keyed(q, x, blocks)
    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(_all(self_match), "qid bigint, doc bigint, score double")


def beyond(queries: DataFrame, corpus: DataFrame, k: int, self_match: bool = True) -> DataFrame:
    """qid, doc, rank of all pairs but the k best of each query, equal scores by ascending doc; ids are bigint.

    The packed corpus is written once and read by every task. Each has a block of the queries, so many that it holds about `HELD`
    scores, and sorts them query by query; no pair is shuffled or written. Where the pairs of one id alone are more than a
    quarter of `HELD`, Spark sorts the pairs, on disk.
    """
    q, x = _sides(queries, corpus)
    n, most = q.groupBy("qid").count().agg(F.count(F.lit(1)), F.max("count")).first()
    m = max(x.count(), 1)
    if m * (most or 1) * 4 > HELD:
        order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc"))
        return pairs(queries, corpus, self_match).withColumn("rank", F.row_number().over(order)).where(F.col("rank") > k).select("qid", "doc", "rank")
    kind = "f4" if x.schema["dvec"].dataType.elementType.typeName() == "float" else "f8"
    blocks = -(-n // max(1, min(HELD // m, -(-n // q.sparkSession.sparkContext.defaultParallelism)))) or 1
    packed = x.mapInArrow(_packed(kind), "docs binary, dvecs binary").repartition(1)
    own = q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).groupBy("qb").applyInArrow(_packed_queries, "qb int, qids binary, qvecs binary")
    met = packed.hint("shuffle_replicate_nl").crossJoin(own.repartitionById(blocks, F.col("qb")).hint("shuffle_replicate_nl"))
    return met.mapInArrow(_beyond(k, self_match, kind), "qid bigint, doc bigint, rank int")
