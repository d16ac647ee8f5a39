"""Exact inner-product retrieval, ranks and rank metrics.

Scoring every query against every item is what an exact flat index means. Two forms give the same rows: `scores` +
`top_k` (or `optimistic_rank`) in SQL, where other work needs the scores of all pairs, and `top_k_blocks` (or `grid.ranks`),
where blocks of queries and corpus meet in a grid join and pairs never become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelquery.functions.vector import dot
from reelquery.operators import grid
from reelquery.operators.quantiles import exact

#: Bytes of a query side that may be broadcast.
BROADCAST_BYTES = 64 << 20


def scores(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """qid, doc, score of all pairs. queries: qid, qvec; corpus: doc, dvec. The query side is broadcast if it is small, else blocks of both sides meet by key."""
    n = queries.count()
    dim = queries.select(F.max(F.size("qvec"))).first()[0] or 1
    score = dot(F.col("qvec"), F.col("dvec")).alias("score")
    if n * (16 + 8 * dim) <= BROADCAST_BYTES:
        return corpus.crossJoin(F.broadcast(queries)).select("qid", "doc", score)
    left, right = grid.keyed(queries, corpus, grid.sizes(queries, corpus))
    return left.join(right, ["qb", "cb"]).select("qid", "doc", score)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their 1-based rank; equal scores by ascending doc. Fewer rows if the corpus is smaller."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_1(scored: DataFrame) -> DataFrame:
    """The best of each query, by partial aggregation; the smallest doc on a tie."""
    return scored.groupBy("qid").agg(F.max_by("doc", F.struct("score", -F.col("doc"))).alias("doc"), F.max("score").alias("score"))


def top_k_blocks(queries: DataFrame, corpus: DataFrame, k: int, self_match: bool = True) -> DataFrame:
    """top_k of scores with bigint ids, by the grid join, for query sides of any size."""
    return top_k(grid.nearest(queries, corpus, k, self_match), k)


def optimistic_rank(scored: DataFrame, positives: DataFrame) -> DataFrame:
    """qid, rank: one more than the number of docs that score strictly higher than the positive. positives: qid, pos."""
    pos = scored.join(positives, [scored.qid == positives.qid, scored.doc == positives.pos]).select(positives.qid, F.col("score").alias("pos_score"))
    return scored.join(pos, "qid").groupBy("qid").agg((F.sum((F.col("score") > F.col("pos_score")).cast("int")) + 1).cast("int").alias("rank"))


def listed_rank(ids: Column, target: Column, rank_k: int) -> Column:
    """1-based place of the target in a list, -1 if it isn't among the first rank_k."""
    at = F.array_position(ids, target)
    return F.when(at.between(1, rank_k), at).otherwise(-1).cast("int")


def retrieve(queries: DataFrame, corpus: DataFrame, topk: int, rank_k: int = 0, self_match: bool = True) -> DataFrame:
    """The retrieval service as a batch: qid, ids, scores, and with rank_k the rank of column `target` (-1 beyond rank_k, which is cut to the corpus' size). Scored by the grid join; ids are bigint."""
    if rank_k:
        rank_k = min(rank_k, corpus.count())
    top = top_k_blocks(queries, corpus, max(topk, rank_k), self_match)
    lists = top.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "doc", "score"))).alias("hits"))
    ids = F.transform("hits", lambda h: h["doc"])
    out = lists.select("qid", F.slice(ids, 1, topk).alias("ids"), F.slice(F.transform("hits", lambda h: h["score"]), 1, topk).alias("scores"), ids.alias("all_ids"))
    if not rank_k:
        return out.drop("all_ids")
    return out.join(queries.select("qid", "target"), "qid").select("qid", "ids", "scores", listed_rank(F.col("all_ids"), F.col("target"), rank_k).alias("rank"))


def recall_at(ranks: Column, k: int) -> Column:
    return F.avg(F.when((ranks >= 1) & (ranks <= k), 1.0).otherwise(0.0))


def rank_metrics(df: DataFrame, rank: str, ks: tuple[int, ...] = (1, 5, 10), digits: int = 6) -> DataFrame:
    """Over valid ranks only (non-null and at least 1): n, mean_rank, median_rank, mrr, r_at_k; one row, of nulls but for n where none is valid. The exact median is found at once, in bounded memory."""
    valid = df.select(F.col(rank).alias("r")).where("r >= 1").persist()
    r = F.col("r")
    half = exact(valid, r, 0.5)
    out = valid.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(r), digits).alias("mean_rank"), F.lit(half).cast("double").alias("median_rank"), F.round(F.avg(1 / r), digits).alias("mrr"), *[F.round(recall_at(r, k), digits).alias(f"r_at_{k}") for k in ks])
    one = df.sparkSession.createDataFrame(out.collect(), out.schema)  # one row
    valid.unpersist()
    return one


def rank_report(df: DataFrame, rank: str, ks: tuple[int, ...] = (1, 5, 10), digits: int = 6) -> DataFrame:
    """rank_metrics, without a row where no rank is valid."""
    return rank_metrics(df, rank, ks, digits).where("n > 0")


def rank_curve(df: DataFrame, rank: str, most: int, digits: int = 6) -> DataFrame:
    """k, recall for every k from 1 to `most`, over all rows. Counts ranks first, so rows aren't multiplied by k."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    by_rank = df.where(F.col(rank).between(1, most)).groupBy(F.col(rank).cast("int").alias("k")).count()
    ks = df.sparkSession.range(1, most + 1).select(F.col("id").cast("int").alias("k"))
    filled = ks.join(by_rank, "k", "left").crossJoin(total)
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # `most` rows
    return filled.select("k", F.round(F.sum(F.coalesce("count", F.lit(0))).over(w) / F.greatest(F.col("total"), F.lit(1)), digits).alias("recall"))


def rerank_head(scored: DataFrame, k: int) -> DataFrame:
    """qid, doc, orig_rank, rank: the k best by `score` reordered by `new_score`; the others keep their rank."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc"))
    ranked = scored.withColumn("orig_rank", F.row_number().over(w))
    head = Window.partitionBy("qid", F.col("orig_rank") <= k).orderBy(F.desc("new_score"), F.asc("doc"))
    return ranked.select("qid", "doc", "orig_rank", F.when(F.col("orig_rank") <= k, F.row_number().over(head)).otherwise(F.col("orig_rank")).alias("rank"))


def push_down(scored: DataFrame) -> DataFrame:
    """qid, down: by how many places the item that was best by `score` falls under `new_score` (ties don't count)."""
    best = scored.groupBy("qid").agg(F.max_by("new_score", F.struct("score", -F.col("doc"))).alias("own"))
    return scored.join(best, "qid").groupBy("qid").agg(F.sum((F.col("new_score") > F.col("own")).cast("int")).cast("int").alias("down"))


def push_down_blocks(queries: DataFrame, corpus: DataFrame, change: grid.Change, best: Column, self_match: bool = True) -> DataFrame:
    """push_down by the grid join: pairs are counted and never rows. `best` is the changed score as a column of `score` and `doc`."""
    first = grid.nearest(queries, corpus, 1, self_match).select("qid", best.alias("own_score"))
    counted = grid.above(queries.withColumn("qid", F.col("qid").cast("bigint")).join(first, "qid"), corpus, self_match, change)
    return counted.select("qid", F.col("above").cast("int").alias("down"))


def rerank_head_blocks(queries: DataFrame, corpus: DataFrame, k: int, new_score: Column, self_match: bool = True) -> DataFrame:
    """rerank_head by the grid join: the head is found among the k best only, the rest is ranked once and never shuffled."""
    head = top_k_blocks(queries, corpus, k, self_match).withColumn("new_score", new_score)
    w = Window.partitionBy("qid").orderBy(F.desc("new_score"), F.asc("doc"))
    head = head.select("qid", "doc", F.col("rank").alias("orig_rank"), F.row_number().over(w).alias("rank"))
    rest = grid.beyond(queries, corpus, k, self_match).withColumnRenamed("rank", "orig_rank")
    return head.unionByName(rest.select("qid", "doc", "orig_rank", F.col("orig_rank").alias("rank")))
