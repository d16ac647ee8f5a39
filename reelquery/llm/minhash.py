"""MinHash near-duplicates with tensored banding; candidates are confirmed on full shingle sets.

Two small collections of `M` keys, each of `A` minhashes, are computed for a document. The M*M tables of the banding
have the pairs (left key i, right key j) as keys, so 2*M*A minhashes serve M*M tables of 2*A rows instead of 2*A*M*M.
With M=11, A=3, two documents of Jaccard 0.8 share a table with probability 0.999, of 0.85 with 0.9999.

1. Documents with equal shingle sets become one class, named after the smallest id.
2. Only keys that another class shares enter the tensor product: a class without a shared left or right key has no
   partner. Most documents end here.
3. In each bucket, every class is paired with the smallest one (no bucket is expanded into all pairs), pairs are
   confirmed, and confirmed links give provisional components. Classes of one component need no further link.
4. A bucket whose classes now lie in several components may hide links between classes that are both unlike the
   smallest. There, all are paired with the class whose shingles are the most common; then a prefix filter over the
   classes' shingles, rarest first, with the places of what they share, gives every pair of different components that
   can still be linked. Should that take long (more than `FEW` pairs for each class to look at, as with several centres;
   they are counted, not made), classes outside the largest component are paired with the most common one of them that
   hasn't been tried, as long as that adds links. So every pair that shares a bucket is confirmed, refuted, ruled out by
   a bound, or already connected.

Scale: signatures are one row a document; exchanges carry ids and hashes, and the shingle sets of candidates: those that a
bounded filter lets through are made and written once, shuffled by merge joins, and compared in the JVM. Hot
buckets are aggregated before the shuffle or joined by joins that split hot keys. Components are found by the cluster,
with checkpoint() after each round; few links are a round of one task. What an action has shuffled goes when it ends.

Defined results: documents without a word (null, empty, white space) have n_shingles 0 and link with nothing;
shorter texts than a shingle count as one shingle of all their words; rows that share an id are one node; a null id
links with nothing and is kept; columns other than id and text are not read; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelquery.llm.bits import maybe_in
from reelquery.llm.common import Scratch, cut, shuffles_freed
from reelquery.llm.components import components, spread_join
from reelquery.llm.words import mix, shingles, spaced_words, word_hashes
from reelquery.llm.worker import tidy

#: Keys in each of the two collections, and minhashes in a key.
M, A = 11, 3
#: Pairs for each class of a crowded bucket that are compared without another pivot, and how often one is tried.
FEW, ROUNDS = 8, 6
_SEEDS = mix(np.arange(1, 2 * M * A + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Distinct hashes of the text's shingles, ascending."""
    return np.unique(shingles(word_hashes(spaced_words(text)), k)) if text else np.zeros(0, np.uint64)


def keys_of(sets: list[np.ndarray]) -> np.ndarray:
    """The 2*M keys of each non-empty set."""
    joined = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    out = np.zeros((len(sets), 2 * M), np.uint64)
    for i in range(2 * M):
        key = np.full(len(sets), i, np.uint64)
        for seed in _SEEDS[i * A : (i + 1) * A]:
            h = (joined ^ seed) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x9E3779B97F4A7C15)
            key = key * np.uint64(0xC4CEB9FE1A85EC53) + np.minimum.reduceat(h, starts)
        out[:, i] = mix(key)
    return out


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(ids):
                sets, held, end = [], 0, at
                while end < len(ids) and held < 150_000:
                    sets.append(shingle_set(texts[end].as_py(), k))
                    held += len(sets[-1])
                    end += 1
                some = [i for i, s in enumerate(sets) if len(s)]
                keys = np.zeros((len(sets), 2 * M), np.uint64)
                if some:
                    keys[some] = keys_of([sets[i] for i in some])
                digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                flat = pa.array(keys.view(np.int64).reshape(-1))
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.frombuffer(b"".join(d[:8] for d in digest), np.int64)), pa.array(np.frombuffer(b"".join(d[8:] for d in digest), np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * 2 * M), flat)], names=["id", "n", "s1", "s2", "keys"])
                at = end

    return run


def _sets(k: int):
    """id and the shingle set of each text, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                sets = [shingle_set(x.as_py(), k).view(np.int64) for x in part.column(1)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["id", "t"])

    return run


class Links:
    """Pairs that have been compared, and the links found among them."""

    def __init__(self, sets: DataFrame, percent: int, scratch: Scratch):
        self.sets, self.percent, self.scratch = sets, percent, scratch
        none = scratch.spark.createDataFrame([], "a bigint, b bigint")
        self.tested = self.links = none
        self.n = 0

    def test(self, pairs: DataFrame) -> int:
        """Compares pairs (a, b) that haven't been compared, on their full sets; how many links that adds."""
        new = self.scratch.keep(pairs.distinct().join(self.tested, ["a", "b"], "left_anti"))
        # Merge joins at every size: the sets of candidates grow with the data.
        other = self.sets.select(F.col("id").alias("b"), F.col("t").alias("tb"))
        hub = self.sets.select(F.col("id").alias("a"), F.col("t").alias("ta"))
        both = spread_join(spread_join(new, other.hint("merge"), "b"), hub.hint("merge"), "a")
        both = both.select("a", "b", (F.size("ta") + F.size("tb")).alias("n"), F.size(F.array_intersect("ta", "tb")).alias("k"))
        found = self.scratch.keep(both.where(100 * F.col("k") >= self.percent * (F.col("n") - F.col("k"))).select("a", "b"))
        self.tested, self.links = self.tested.union(new), self.links.union(found)
        added = found.count()
        self.n += added
        return added

    def components(self) -> DataFrame:
        return components(self.links, self.n)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n (shingles), component (the smallest id reachable by links; the id itself if none)."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    with shuffles_freed(docs.sparkSession):
        signed, classes, found = _found(rows, words, percent)
    # Every document by its class, every class by its component.
    of_set = classes.select("s1", "s2", F.col("id").alias("rep"))
    joined = _by_set(signed, of_set)
    return spread_join(joined, found.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("id", "n", F.coalesce("comp", "rep", "id").alias("component"))


def _found(rows: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (id, text): one row each with n and the hashes s1, s2 of its set, the classes (id, n, s1, s2), and the components (node, comp) of the classes that have links."""
    scratch = Scratch(rows.sparkSession)
    signed = cut(rows.mapInArrow(tidy(_signatures(words)), "id bigint, n bigint, s1 bigint, s2 bigint, keys array<bigint>"))
    real = signed.where("n > 0 and id is not null")
    classes = cut(real.groupBy("s1", "s2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys")))

    # 2. Keys that two classes share.
    single = classes.select("id", "n", F.posexplode("keys").alias("i", "key")).select("id", "n", "i", F.xxhash64("i", "key").alias("key"))
    shared = single.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key")
    own = spread_join(single, shared, "key").groupBy("id", "n").agg(F.collect_list(F.when(F.col("i") < M, F.col("key"))).alias("left"), F.collect_list(F.when(F.col("i") >= M, F.col("key"))).alias("right"))
    own = scratch.keep(own.where("size(left) > 0 and size(right) > 0"))

    # 3. Buckets of the tensor product; each class with the smallest of its bucket.
    members = own.select("id", "n", "right", F.explode("left").alias("l")).select("id", "n", "l", F.explode("right").alias("r")).select(F.xxhash64("l", "r").alias("bucket"), "id", "n")
    at = F.struct("id", "n")
    buckets = scratch.keep(members.groupBy("bucket").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count(F.lit(1)).alias("c")).where("lo.id <> hi.id"))
    in_crowd = scratch.keep(spread_join(members, buckets.where("c > 2").select("bucket", "lo"), "bucket"))
    two = buckets.where("c = 2").select(F.col("lo.id").alias("a"), F.col("hi.id").alias("b"), F.col("lo.n").alias("na"), F.col("hi.n").alias("nb"))
    star = in_crowd.where("id <> lo.id").select(F.col("lo.id").alias("a"), F.col("id").alias("b"), F.col("lo.n").alias("na"), F.col("n").alias("nb"))
    pairs = scratch.keep(two.union(star).distinct())
    met = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = scratch.keep(maybe_in(rows.where("id is not null and text is not null"), met, "id", _sets(words), "id bigint, t array<bigint>"))
    links = Links(sets, percent, scratch)
    links.test(pairs.where(_fits("na", "nb", percent)).select("a", "b"))
    found = links.components()

    # 4. Buckets over several components.
    placed = _mixed(in_crowd.select("bucket", "id", "n"), found, scratch)
    if not placed.isEmpty():
        profiles = _profiles(placed, sets, percent, scratch)
        most = FEW * profiles.count()
        tried = scratch.spark.createDataFrame([], "bucket bigint, id bigint")
        for round in range(ROUNDS):
            pivots = (placed.where("comp <> main") if round else placed).join(tried, ["bucket", "id"], "left_anti")
            pivots = spread_join(pivots, profiles.select("id", "score"), "id")
            pivots = pivots.groupBy("bucket").agg(F.max(F.struct("score", "id", "n", "comp")).alias("p")).select("bucket", F.col("p.id").alias("p"), F.col("p.n").alias("pn"), F.col("p.comp").alias("pc"))
            pivots = scratch.keep(pivots)
            tried = tried.union(pivots.select("bucket", F.col("p").alias("id")))
            others = spread_join(placed.where("comp <> main") if round else placed, pivots, "bucket").where((F.col("comp") != F.col("pc")) & _fits("n", "pn", percent))
            added = links.test(others.select(F.col("p").alias("a"), F.col("id").alias("b")).where("a <> b"))
            if added:
                found = links.components()
                placed = _mixed(placed.select("bucket", "id", "n"), found, scratch)
            if not added or _work(placed, profiles) <= most:
                break
        if links.test(_rest(placed, profiles, percent)):
            found = links.components()

    scratch.drop()
    return signed, classes, found


def _fits(n: str, o: str, percent: int):
    """Whether sets of these sizes can be linked."""
    return 100 * F.least(n, o) >= percent * F.greatest(n, o)


def _mixed(members: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of members (bucket, id, n) with their component and the one that most members of the bucket are in, of buckets that span several."""
    # A class and its component meet in one group (of M * M buckets at most), not once for each bucket.
    none = F.lit(None).cast("bigint")
    both = members.select("id", "n", "bucket", none.alias("comp")).union(found.select("node", none, none, "comp"))
    each = both.groupBy("id").agg(F.max("n").alias("n"), F.max("comp").alias("comp"), F.collect_list("bucket").alias("buckets"))
    placed = each.select(F.explode("buckets").alias("bucket"), "id", "n", F.coalesce("comp", "id").alias("comp"))
    counts = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = counts.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("x"), F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket", F.col("x.comp").alias("main"))
    return scratch.keep(spread_join(placed, mixed, "bucket"))


def _profiles(placed: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """id, n, score (how common its shingles are among the members' on average) and the prefix of each member.

    The prefix holds a member's rarest shingles, rarest first (by their number among the members, then by hash): so
    many that a linked set must hold one of them.
    """
    wanted = placed.select("id").distinct()
    tokens = scratch.keep(maybe_in(sets, wanted, "id").select("id", F.explode("t").alias("t")).distinct())
    often = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    sets = spread_join(tokens, often, "t").groupBy("id").agg(F.avg("f").alias("score"), F.sort_array(F.collect_list(F.struct("f", "t"))).alias("all"))
    n = F.size("all")
    prefix = F.slice("all", 1, (n - F.ceil(n * percent / 100) + 1).cast("int"))
    return scratch.keep(sets.select("id", n.cast("bigint").alias("n"), "score", prefix.alias("prefix")))


def _prefixes(placed: DataFrame, profiles: DataFrame) -> DataFrame:
    """id, n, comp, stray (outside the component that most of a bucket are in), and place i and hash t of each shingle of its prefix that another member has."""
    where = placed.groupBy("id").agg(F.min("comp").alias("comp"), F.max(F.col("comp") != F.col("main")).alias("stray"))
    return spread_join(profiles, where, "id").select("id", "n", "comp", "stray", F.posexplode("prefix").alias("i", "x")).where("x.f > 1").select("id", "n", "comp", "stray", "i", F.col("x.t").alias("t"))


def _work(placed: DataFrame, profiles: DataFrame) -> int:
    """How many pairs `_rest` has to look at: of each shingle, the strays that have it times all that do."""
    each = _prefixes(placed, profiles).groupBy("t").agg(F.count_if("stray").alias("s"), F.count(F.lit(1)).alias("c"))
    return int(each.agg(F.sum(F.col("s").cast("double") * F.col("c"))).first()[0] or 0)


def _rest(placed: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members in different components that may still be linked, one of them outside the component that most of a bucket are in.

    With both sets in the same order, linked ones share a shingle of their prefixes. If the first one shared stands at
    the places i and j (from 0), they share no more than 1 + min(n - i - 1, m - j - 1), which must reach what a link
    asks of sets of their sizes. Near copies that stay apart differ in shingles that are rare, and rare ones come
    first, so what nearly all have in common makes no pairs.
    """
    rows = _prefixes(placed, profiles)
    other = rows.select("t", *[F.col(c).alias(f"o_{c}") for c in ("id", "n", "comp", "stray", "i")])
    least = F.ceil(percent * (F.col("n") + F.col("o_n")) / (100 + percent))
    enough = 1 + F.least(F.col("n") - F.col("i"), F.col("o_n") - F.col("o_i")) - 1 >= least
    # A pair of strays is made once.
    once = ~F.col("o_stray") | (F.col("id") < F.col("o_id"))
    pairs = spread_join(rows.where("stray"), other, "t").where((F.col("comp") != F.col("o_comp")) & enough & once & _fits("n", "o_n", percent))
    return pairs.select(F.col("o_id").alias("a"), F.col("id").alias("b")).distinct()


def _by_set(signed: DataFrame, of_set: DataFrame) -> DataFrame:
    left = signed.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.struct("s1", "s2")).alias("s"))
    return spread_join(left, of_set.select(F.struct("s1", "s2").alias("s"), "rep"), "s", "left").select("id", "n", "rep")


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents' rows of which each group of near-duplicates keeps the one with the smallest id (once, if its row is repeated); rows with a null id stay."""
    found = near_duplicates(docs, doc_id=doc_id, text=text, words=words, percent=percent)
    # An id stays if no row of it belongs to a smaller one.
    info = found.where("id is not null").groupBy(F.col("id").alias("__id")).agg(F.max(F.col("component") != F.col("id")).alias("__gone"), F.count(F.lit(1)).alias("__n"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = docs.select(row.alias("__row"), F.col(f"`{doc_id}`").cast("bigint").alias("__id"))
    kept = spread_join(marked.where("__id is not null"), info, "__id").where("not __gone")
    once = Window.partitionBy("__id").orderBy(F.xxhash64("__row"), F.col("__row").cast("string"))
    repeated = kept.where("__n > 1").withColumn("__rn", F.row_number().over(once)).where("__rn = 1").select("__row")
    out = kept.where("__n = 1").select("__row").union(repeated).union(marked.where("__id is null").select("__row"))
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def op5(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs, words=4, percent=80)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
