"""Hard negatives and in-batch negatives from scored pairs (qid, doc, score) and positives (qid, pos)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelquery.functions.permute import half_bits, permuted
from reelquery.operators import grid
from reelquery.operators.order import numbered
from reelquery.operators.retrieval import top_k


def hard_negatives(scored: DataFrame, positives: DataFrame, pool: int, most: int) -> DataFrame:
    """qid, doc, score, raw_rank, place: of the pool's best, all but the positive, at most `most` of them (0: no limit). raw_rank is the rank before the positive is taken out and so has a gap."""
    top = top_k(scored, pool).withColumnRenamed("rank", "raw_rank").join(positives, "qid").where("doc <> pos")
    w = Window.partitionBy("qid").orderBy("raw_rank")
    out = top.withColumn("place", F.row_number().over(w)).drop("pos")
    return out.where(F.col("place") <= most) if most else out


def negatives_with_ranks(scored: DataFrame, positives: DataFrame, topk: int, depth: int = 0) -> DataFrame:
    """qid, ids, scores, ranks in order of score. Looks max(1, depth, topk + 1) deep; a topk of 0 still gives one."""
    found = hard_negatives(scored, positives, max(1, depth, topk + 1), max(1, topk))
    rows = F.sort_array(F.collect_list(F.struct("place", "doc", "score", "raw_rank")))
    return found.groupBy("qid").agg(rows.alias("r")).select("qid", F.transform("r", lambda x: x["doc"]).alias("ids"), F.transform("r", lambda x: x["score"]).alias("scores"), F.transform("r", lambda x: x["raw_rank"]).alias("ranks"))


def mined_online(scored: DataFrame, banned: DataFrame, k: int) -> DataFrame:
    """The k best that aren't banned (qid, doc)."""
    return top_k(scored.join(banned, ["qid", "doc"], "left_anti"), k)


def mined_blocks(queries: DataFrame, corpus: DataFrame, positives: DataFrame, k: int, allowed, self_match: bool = True) -> DataFrame:
    """mined_online by the grid join, where a rule of ids (see grid.nearest) and the positive (qid, pos; one a query) ban: one more is looked for, as the positive may be among them."""
    found = grid.nearest(queries, corpus, k + 1, self_match, allowed).join(positives.select("qid", "pos"), "qid").where("doc <> pos")
    return top_k(found.drop("pos"), k)


def in_batch(batch: DataFrame) -> DataFrame:
    """qid, neg: the other rows' items in a batch that differ from the own. batch: batch_id, qid, gt. Batches are small by definition."""
    a, b = batch.alias("a"), batch.alias("b")
    return a.join(b, "batch_id").where("a.qid <> b.qid and a.gt <> b.gt").select(F.col("a.qid").alias("qid"), F.col("b.gt").alias("neg")).distinct()


def merged_sources(*sources: DataFrame) -> DataFrame:
    """The distinct (qid, neg) of several sources."""
    out = sources[0].select("qid", "neg")
    for s in sources[1:]:
        out = out.unionByName(s.select("qid", "neg"))
    return out.distinct()


def pooled(sources: list[DataFrame], size: int, docs: DataFrame | None = None, queries: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """qid, neg, place: negatives from sources in order of priority (each qid, neg, at), each negative once, `size` a query; with docs and
    queries (qid, pos), pools that are too small are filled with random docs that aren't the positive or in the pool."""
    every = None
    for n, s in enumerate(sources):
        part = s.select("qid", "neg", F.lit(n).alias("source"), F.col("at").cast("bigint").alias("at"))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy("qid", "neg").agg(F.min(F.struct("source", "at")).alias("p"))
    w = Window.partitionBy("qid").orderBy("p.source", "p.at", "neg")
    chosen = first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= size).select("qid", "neg", "place")
    if docs is None:
        return chosen
    missing = queries.join(chosen.groupBy("qid").agg(F.count(F.lit(1)).alias("has")), "qid", "left").fillna(0, ["has"])
    drawn = random_negatives(docs, missing, F.lit(size) - F.col("has"), seed, chosen.select("qid", F.col("neg").alias("doc")))
    filled = drawn.join(missing.select("qid", "has"), "qid").select("qid", F.col("doc").alias("neg"), (F.col("place") + F.col("has")).cast("int").alias("place"))
    return chosen.unionByName(filled)


def strict(df: DataFrame, margin: float, k: int) -> DataFrame:
    """Rows (qid, neg, sim_pos_before, sim_neg_before, sim_neg_after) of which the negative was below the positive by more than the margin; the k nearest after the change."""
    kept = df.where(F.col("sim_neg_before") < F.col("sim_pos_before") - margin)
    w = Window.partitionBy("qid").orderBy(F.desc("sim_neg_after"), F.asc("neg"))
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def hash_order(*keys: Column, seed: int = 0) -> Column:
    """A deterministic random order of keys: md5 of the seed and the keys, the same in any SQL engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def random_negatives(docs: DataFrame, queries: DataFrame, need: int | Column, seed: int = 0, banned: DataFrame | None = None) -> DataFrame:
    """qid, doc, place: `need` random docs of each query, without replacement, none of them its `pos` or banned (qid, doc).

    Each query draws by a permutation of its own (`functions.permute`): its tries are the permutation's first places, of which
    those beyond the docs or banned are passed over, a bounded number of times; what is still missing is filled in order
    of the docs. Docs are distinct; their places follow their order.
    """
    ring = docs.select("doc")
    n = ring.count()
    placed = numbered(ring, ["doc"], "at")
    no = queries.select("qid", F.col("pos").alias("doc")).where("doc is not null")
    no = no.unionByName(banned.select("qid", "doc")).distinct() if banned is not None else no
    wanted = queries.select("qid", (need if isinstance(need, Column) else F.lit(need)).cast("bigint").alias("need"))
    wanted = wanted.join(no.groupBy("qid").agg(F.count(F.lit(1)).alias("banned")), "qid", "left").fillna(0, ["banned"]).where("need > 0")
    domain = 1 << 2 * half_bits(n)
    tries = F.least(F.lit(domain), 8 * (F.col("need") + F.col("banned")) + 64)
    steps = wanted.withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), tries - 1)))
    drawn = permuted(steps, "step", "qid", n, seed, "at").join(placed, "at").join(no, ["qid", "doc"], "left_anti")
    own = Window.partitionBy("qid").orderBy("step")
    picked = drawn.withColumn("place", F.row_number().over(own)).where("place <= need").select("qid", "doc", "place", "need")
    short = wanted.join(picked.groupBy("qid").agg(F.count(F.lit(1)).alias("has")), "qid", "left").fillna(0, ["has"]).where(F.col("has") < F.least(F.col("need"), F.lit(n)))
    # Among the first need + banned docs enough are neither banned nor picked, if the docs suffice at all.
    rest = short.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("need") + F.col("banned")))).join(placed, "at")
    rest = rest.join(no, ["qid", "doc"], "left_anti").join(picked, ["qid", "doc"], "left_anti")
    late = Window.partitionBy("qid").orderBy("at")
    filled = rest.withColumn("place", (F.row_number().over(late) + F.col("has")).cast("int")).where("place <= need")
    return picked.select("qid", "doc", "place").unionByName(filled.select("qid", "doc", "place"))
