"""Toxicity by class-conditional Kneser-Ney language models.

For toxic and for ordinary text there is a bigram model over words with Kneser-Ney smoothing: counts of a class are
discounted and backed off to the class's continuation counts (in how many different contexts a word follows), and
these to continuation counts shared by both classes, so an expression that is rare in both says little. A text's first
feature is the length-normalised difference of its log-likelihoods, log P(toxic) - log P(ordinary), by the two whole
models: words and pairs that only one class holds, and those that none holds, count with what either model gives them.

The other features are of what toxic text holds, so that a long text cannot drown a toxic passage: the evidence of a
word is log P(toxic) - log P(ordinary) by the continuation counts alone, and given the word before it. Here words and
pairs that no toxic text holds say nothing. For either evidence there are its mean and how much of it lies beyond
`BEYOND`. A logistic curve makes a probability of all features.

Counts cover all training rows (three of five folds; one more fits the curve, on which rows that count would look better
than unseen ones, and one is held out) and are never cut. The model is a cluster table of the evidence of each word and
pair of either class. A text's log-ratio is a sum over its words (of the word and of the backoff after it) and over
those of its pairs that training rows hold (what their own counts add). Every sum over a text is a sum over its words
and pairs: workers add up what their cache of the `MOST_CACHED` most frequent rows holds; other keys of a text that may
be in the table (by a filter of bounded size) are joined to it, and their sums are added. So scores don't depend on
either bound, and no text has to meet the model. A hash takes at most about `MOST_ROWS` rows for the curve's nine weights.

Scale: labelled texts are shuffled once, to meet their labels (such a filter spares texts without one); pairs are
aggregated in Python before their shuffle, which is salted for frequent words; scoring takes each text once and
shuffles sums and keys, never texts. Copies of a text share their sums. The disk holds one step at a time: the evidence is
written in buckets of its key, which the texts' keys meet where they lie, `SLICES` parts of the texts one after the other;
all texts are scored, by the whole model. What a step has shuffled goes when it ends.

Defined results: null, empty and wordless texts get the score of no evidence; null labels teach nothing; a document
with two labels counts for each; without any label, or with one class only, scores are the rate of that class; repeated
rows are scored one by one; an empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.llm.bits import Bits, PackedBits, maybe_in
from reelquery.llm.common import ROW, Scratch, cut, delete, groups, new_path, shuffle_partitions, shuffles_freed
from reelquery.llm.components import spread_join
from reelquery.llm.words import MOST_WORDS, alnum_words, mix, word_hashes
from reelquery.llm.worker import tidy

#: Rows of the model that are broadcast, and how often they must have been seen.
MOST_CACHED, LEAST_CACHED = 600_000, 2
#: Rows that fit the curve; discount; the most that one word weighs; shares of a hot word (a power of two).
MOST_ROWS, DISCOUNT, MOST_EVIDENCE, SALT = 20_000, 0.75, 6.0, 16
#: Evidence beyond these counts as strong, and as very strong.
BEYOND = (1.0, 3.0)
#: The most frequent words, toxic or not, are broadcast to the pairs they are in, up to so many; pairs of others are joined to them.
MOST_TOXIC_WORDS = 200_000
#: Parts of the texts that are scored, and of the evidence that is dealt to buckets, one after the other. No result depends on it.
SLICES = 6
#: Bytes of text whose pairs are counted together.
COUNTED_BYTES = 16 << 20
SUMS = tuple(f"{kind}_{part}" for kind in ("given", "alone") for part in ("sum", "strong", "very")) + ("ratio_sum",)
FEATURES = ("given_mean", "given_strong", "given_very", "alone_mean", "alone_strong", "alone_very", "size", "ratio_mean")
#: Hash of the start of a text.
START = np.zeros(1, np.int64)
#: Bytes of text that are scored together.
SCORED_BYTES = 2 << 20


def _id(h: np.ndarray) -> np.ndarray:
    """Hashes as ids of words: their upper 48 bits, above 16 zero bits."""
    return h.view(np.int64) & ~0xFFFF


def _low(word: np.ndarray) -> np.ndarray:
    """Ids with the zero bits on top. Beside another id, 12 bytes that don't compress hold both."""
    return (word.view(np.uint64) >> np.uint64(16)).view(np.int64)


def _words(data: bytes | None) -> np.ndarray:
    return _id(word_hashes(alnum_words(data))) if data else START[:0]


def _pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(context.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + word.view(np.uint64)).view(np.int64)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, c, o, t): how often the word w follows c in ordinary and in toxic texts, sorted by w. The zero bits of w hold a share of the contexts, which salts hot words."""
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    held = 0
    for batch in batches:
        for x, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            data = x.as_py()
            h = _words(data)
            if len(h):
                found.append((np.concatenate((START, h[:-1])), h, 1 if label else 0))
                held += len(data)
            if held > COUNTED_BYTES:
                yield _counted(found)
                found, held = [], 0
    if found:
        yield _counted(found)


def _counted(found: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
    c, w = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    toxic = np.repeat([x[2] for x in found], [len(x[1]) for x in found])
    c = _low(c)
    w = w | (c & (SALT - 1))
    order = np.lexsort((c, w))
    c, w, toxic = c[order], w[order], toxic[order]
    heads = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (w[1:] != w[:-1]))))
    n = np.diff(np.concatenate((heads, [len(c)])))
    t = np.add.reduceat(toxic, heads)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (w[heads], c[heads], n - t, t)], names=["w", "c", "o", "t"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = _pair_keys(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns[2:]], names=["k", *batch.schema.names[2:]])


@dataclass
class Model:
    """The part of the model that every worker holds, sorted by key."""

    words: np.ndarray
    word_evidence: np.ndarray  # evidence, and the log-ratios of the word and of the backoff after it
    pairs: np.ndarray
    pair_evidence: np.ndarray  # given the context, and of the word alone; the log-ratio of the pair's own counts
    filter: Bits

    @staticmethod
    def find(own: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the keys are held, and whether they are."""
        if not len(own):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.bool_)
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        return at, own[at] == keys


def _least(table: DataFrame, most: int, often: int = 1) -> tuple[Column, int]:
    """A grade of the rows by their count n, and the least grade of which, with those above, at most `most` rows are (seen `often` times at least)."""
    grade = F.floor(8 * F.log2("n"))  # a few hundred grades at most
    kept, least = 0, 1 << 30
    for g, n in sorted(((r[0], r[1]) for r in table.groupBy(grade.alias("g")).count().collect()), reverse=True):
        kept += n
        if kept > most or g < 8 * int(np.log2(often)):
            break
        least = g
    return grade, least


def evidence_table(labelled: DataFrame, scratch: Scratch) -> tuple[DataFrame, float, float]:
    """The models of the rows (text: binary, toxic: int), in scratch, and the log-ratios of a word that no row holds and of the backoff at a text's start.

    A row is a key k, a count n, and of a word: e (its evidence), ratio (log-ratio of its continuation probabilities, less that
    of a word that no row holds) and after (log-ratio of the backoff after it); of a pair: e, alone (the evidence of its word) and
    ratio (what its own counts add to the log-ratio). Pairs that no toxic row holds have no evidence beside their word's.
    """
    own = Scratch(labelled.sparkSession)
    each = labelled.mapInArrow(tidy(_pairs), "w bigint, c bigint, o bigint, t bigint")
    pairs = each.repartition("w").groupBy("w", "c").agg(F.sum("o").alias("o"), F.sum("t").alias("t"))
    pairs = own.keep(pairs.select(F.col("w").bitwiseAND(F.lit(~0xFFFF).cast("bigint")).alias("w"), F.shiftleft("c", 16).alias("c"), "o", "t"))
    one = lambda n: (F.col(n) > 0).cast("bigint")
    names = ("f", "fo", "ft", "so", "st", "do", "dt")

    def row(a: str, **found: Column) -> Column:
        return F.struct(F.col(a).alias("a"), *[found.get(x, F.lit(0)).cast("bigint").alias(x) for x in names])

    follows = row("w", f=F.lit(1), fo=one("o"), ft=one("t"))
    contexts = row("c", so=F.col("o"), st=F.col("t"), do=one("o"), dt=one("t"))
    rows = pairs.select(F.explode(F.array(follows, contexts)).alias("x")).select("x.*")
    counts = own.keep(rows.groupBy("a").agg(*[F.sum(x).alias(x) for x in names]))
    size, f, fo, ft, of_o, of_t = (float(x or 0) for x in counts.agg(F.sum(one("f")), *[F.sum(x) for x in ("f", "fo", "ft")], *[F.sum(one(x)) for x in ("fo", "ft")]).first())

    # Continuation counts: the class's, backed off to the shared ones, and these to a uniform share of all words and one more.
    less = lambda n: F.greatest(F.col(n) - DISCOUNT, F.lit(0.0))
    share = DISCOUNT / max(f, DISCOUNT * (size + 1))
    whole = max(f - DISCOUNT * size, 0) / max(f, 1) + share * (size + 1)
    low, rest = {}, {}
    for name, total, kinds in (("fo", fo, of_o), ("ft", ft, of_t)):
        rest[name] = (DISCOUNT * kinds if total else 1.0) / whole / max(total, 1)
        low[name] = less(name) / max(total, 1) + (less("f") / max(f, 1) + share) * rest[name]
    unseen = float(np.log(rest["ft"] / rest["fo"]))
    left = lambda s, d: F.when(F.col(s) > 0, DISCOUNT * F.col(d) / F.col(s)).otherwise(1.0)
    clipped = lambda e: F.greatest(F.least(e, F.lit(MOST_EVIDENCE)), F.lit(-MOST_EVIDENCE))
    words = counts.select("a", "f", "ft", F.greatest(F.col("so") + F.col("st"), F.col("f")).alias("n"), "so", "st", low["fo"].alias("lo"), low["ft"].alias("lt"), left("so", "do").alias("ro"), left("st", "dt").alias("rt"))
    words = words.withColumn("whole", F.log(F.col("lt") / F.col("lo"))).withColumn("after", F.log(F.col("rt") / F.col("ro")))
    words = words.withColumn("e", F.when(F.col("ft") > 0, clipped(F.col("whole"))).otherwise(0.0))
    start = words.where("a = 0").select("after").first()

    # A pair's counts over what the model backs off to: the log-ratio beyond that of the backoff.
    back = lambda s, r: F.greatest(F.col(s), F.lit(1)) * F.col(r)
    of_c = words.select(F.col("a").alias("c"), back("so", "ro").alias("yo"), back("st", "rt").alias("yt"), "after", "n")
    of_w = words.select(F.col("a").alias("w"), "lo", "lt", "e", "whole", "n")
    grade, least = _least(words, MOST_TOXIC_WORDS)
    near_c, near_w = (F.broadcast(x.where(grade >= least).drop("n")) for x in (of_c, of_w))
    both = pairs.join(near_c, "c").join(near_w, "w")
    if words.where(grade < least).limit(1).count():
        far = pairs.join(near_c, "c", "left").join(near_w, "w", "left").where("yo is null or lo is null").select(*pairs.columns)
        both = both.unionByName(own.keep(spread_join(spread_join(far, of_c.drop("n"), "c"), of_w.drop("n"), "w").select(*both.columns)))
    own_part = lambda n, y, low: F.log1p(less(n) / (F.col(y) * F.col(low)))
    both = both.withColumn("ratio", own_part("t", "yt", "lt") - own_part("o", "yo", "lo"))
    toxic = lambda x: F.when(F.col("t") > 0, x).otherwise(0.0).cast("float")
    e = clipped(F.col("ratio") + F.col("after") + F.col("whole"))
    of_pairs = both.select("c", "w", (F.col("o") + F.col("t")).alias("n"), toxic(e).alias("e"), toxic(F.col("e")).alias("alone"), F.col("ratio").cast("float").alias("ratio"), F.lit(None).cast("float").alias("after"))
    of_pairs = of_pairs.mapInArrow(_keyed, "k bigint, n bigint, e float, alone float, ratio float, after float")
    of_words = words.where("f > 0").select(F.col("a").alias("k"), "n", F.col("e").cast("float").alias("e"), F.lit(None).cast("float").alias("alone"), (F.col("whole") - unseen).cast("float").alias("ratio"), F.col("after").cast("float").alias("after"))
    table = scratch.keep(of_words.union(of_pairs))
    own.drop()
    return table, unseen, float(start[0] if start else 0.0)


def cache(table: DataFrame, more: tuple[str, ...] = ()) -> Model:
    """What workers hold of the table: its most frequent rows (seen `LEAST_CACHED` times at least, on tables of any size; at most `MOST_CACHED`) with e, alone and the columns `more`, and the filter of all."""
    grade, least = _least(table, MOST_CACHED, LEAST_CACHED)
    top = table.where(grade >= least).select("k", "e", "alone", *more).toArrow().sort_by("k")
    k, e, alone, *others = (top[x].to_numpy() for x in ("k", "e", "alone", *more))
    pair = ~np.isnan(alone)
    return Model(k[~pair], np.stack([x[~pair] for x in (e, *others)], 1), k[pair], np.stack([x[pair] for x in (e, alone, *others)], 1), PackedBits(table))


def bucketed(table: DataFrame, name: str, path: str) -> DataFrame:
    """The table's rows as a table of that name in buckets of k, so that no join shuffles them again."""
    spark = table.sparkSession
    buckets = min(shuffle_partitions(spark), 100_000)  # as many as Spark allows
    for part in range(SLICES):
        rows = table.where(F.pmod(F.xxhash64("k"), F.lit(SLICES)) == part).repartition(buckets, "k")
        rows.write.mode("append").format("parquet").bucketBy(buckets, "k").option("path", path).saveAsTable(name)
    return spark.table(name)


class Vocabulary(dict):
    """Words met so far: their hashes, evidence and whether it has to be joined. Emptied when it holds too many."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.hashes, self.evidence, self.missing = START[:0], np.zeros((0, 3)), np.zeros(0, np.bool_)

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code

    def codes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MOST_WORDS:
            self.forget()
        known = len(self)
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        new = list(islice(reversed(self), len(self) - known))[::-1]
        if new:
            h = _id(np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new)))
            at, hit = self.model.find(self.model.words, h)
            e = np.zeros((len(h), 3))
            e[hit] = self.model.word_evidence[at[hit]]
            may = np.zeros(len(h), np.bool_)
            may[self.model.filter.places(h)] = True
            self.hashes = np.concatenate((self.hashes, h))
            self.evidence = np.concatenate((self.evidence, e))
            self.missing = np.concatenate((self.missing, may & ~hit))
        return out


def parts(e: np.ndarray) -> list[np.ndarray]:
    return [e, *[np.maximum(e - b, 0) for b in BEYOND]]


def sums_of(texts: list[bytes | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its words and `SUMS` over what the workers hold, and (text, key, count, count of those before another word) of what has to be joined."""
    model = vocabulary.model
    words = [alnum_words(x) if x else [] for x in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    code = vocabulary.codes(list(chain.from_iterable(words)))
    text = np.repeat(np.arange(len(texts)), n)
    h, (e, ratio, after) = vocabulary.hashes[code], vocabulary.evidence[code].T
    goes_on = np.ones(len(h), np.bool_)
    goes_on[np.cumsum(n)[n > 0] - 1] = False
    before = np.concatenate((START, h[:-1]))[: len(h)]
    before[(np.cumsum(n) - n)[n > 0]] = 0
    keys = _pair_keys(before, h)
    maybe = model.filter.places(keys)
    at, hit = model.find(model.pairs, keys[maybe])
    own = maybe[hit]
    given, alone, pair_ratio, _ = model.pair_evidence[at[hit]].astype(float).T
    out = np.zeros((len(texts), len(SUMS)))
    out[:, 6] = np.bincount(text, ratio + after * goes_on, len(texts)) + np.bincount(text[own], pair_ratio, len(texts))
    for j, (word, x, y) in enumerate(zip(parts(e), parts(given), parts(alone), strict=True)):
        out[:, 3 + j] = np.bincount(text, word, len(texts))
        out[:, j] = out[:, 3 + j] + np.bincount(text[own], x - y, len(texts))
    unknown = np.flatnonzero(vocabulary.missing[code])
    who = np.concatenate((text[unknown], text[maybe[~hit]]))
    what = np.concatenate((h[unknown], keys[maybe[~hit]]))
    before_another = np.concatenate((goes_on[unknown], np.zeros(len(who) - len(unknown), np.bool_)))
    order = np.lexsort((what, who))
    who, what, before_another = who[order], what[order], np.concatenate(([0], np.cumsum(before_another[order])))
    heads = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (what[1:] != what[:-1])))[: len(who)])
    ends = np.concatenate((heads, [len(who)]))
    return n, out, (who[heads], what[heads], np.diff(ends), np.diff(before_another[ends]))


def _sums(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        for batch in batches:
            texts = [x.as_py() for x in batch.column(3)]
            for i, j in groups(texts, SCORED_BYTES):
                n, sums, (who, keys, counts, afters) = sums_of(texts[i:j], vocabulary)
                ends = np.concatenate(([0], np.cumsum(np.bincount(who, minlength=j - i)))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (keys, counts << 32 | afters)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, j - i) for k in range(3)], pa.array(n), *[pa.array(sums[:, k]) for k in range(len(SUMS))], *lists], names=["i", "x", "y", "n", *SUMS, "keys", "counts"])

    return run


def _doc(text: str) -> Column:
    """128 bits that stand for a text."""
    body = F.col(f"`{text}`").cast("binary")
    return F.when(body.isNotNull(), F.struct(F.xxhash64(body).alias("x"), F.xxhash64(F.lit(1), body).alias("y")))


def _features(rows: DataFrame, table: DataFrame, shared, unseen: float, start: float, scratch: Scratch) -> DataFrame:
    """The same of rows (doc, t: the text)."""
    # A text's number is shorter than what stands for the text. Of its two counts of a key, the lower 32 bits are those before another word.
    rows = rows.select(F.monotonically_increasing_id().alias("i"), "doc.x", "doc.y", "t")
    rows = scratch.keep(rows.mapInArrow(tidy(_sums(shared)), "i bigint, x bigint, y bigint, n bigint, " + ", ".join(f"{s} double" for s in SUMS) + ", keys array<bigint>, counts array<bigint>"))
    wanted = rows.where(F.size("keys") > 0).select("i", F.explode(F.arrays_zip("keys", "counts")).alias("x")).select("i", F.col("x.keys").alias("k"), F.col("x.counts").alias("cd"))
    met = wanted.join(table.hint("merge"), "k")  # keys that many training rows hold are in the cache
    met = met.withColumn("c", F.shiftright("cd", 32)).withColumn("d", F.col("cd").bitwiseAND(F.lit((1 << 32) - 1)))
    part = lambda e: [e.cast("double"), *[F.greatest(e.cast("double") - b, F.lit(0.0)) for b in BEYOND]]
    word = F.col("alone").isNull()
    more = [F.col("c") * (x - F.when(word, 0.0).otherwise(y)) for x, y in zip(part(F.col("e")), part(F.col("alone")), strict=True)]
    more += [F.when(word, F.col("c") * x).otherwise(0.0) for x in part(F.col("e"))]
    more.append(F.col("c") * F.col("ratio") + F.col("d") * F.coalesce("after", F.lit(0.0)))
    none = F.lit(None).cast("bigint")
    late = met.select("i", none.alias("x"), none.alias("y"), none.alias("n"), *[x.alias(s) for x, s in zip(more, SUMS, strict=True)])
    every = rows.select("i", "x", "y", "n", *SUMS).union(late)
    each = every.groupBy("i").agg(*[F.max(x).alias(x) for x in ("x", "y", "n")], *[F.sum(s).alias(s) for s in SUMS])
    # Copies of a text have the same sums, but for the order in which they were added.
    total = each.groupBy("x", "y").agg(*[F.max(x).alias(x) for x in ("n", *SUMS)]).withColumn("doc", F.struct("x", "y"))
    mean = lambda s: F.when(F.col("n") > 0, F.col(s) / F.col("n")).otherwise(0.0)
    strong = lambda s: F.log1p(F.greatest(F.col(s), F.lit(0.0)))
    ratio = F.when(F.col("n") > 0, (F.col("ratio_sum") + start) / F.col("n") + unseen).otherwise(0.0)
    columns = [mean("given_sum"), strong("given_strong"), strong("given_very"), mean("alone_sum"), strong("alone_strong"), strong("alone_very"), F.log1p("n"), ratio]
    return total.select("doc", *[c.alias(x) for c, x in zip(columns, FEATURES, strict=True)])


def features(docs: DataFrame, text: str, table: DataFrame, model: Model, unseen: float, start: float) -> DataFrame:
    """doc (see `_doc`) and the features of each different text. Copies of a text are in one slice."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.where(F.col(f"`{text}`").isNotNull()).select(_doc(text).alias("doc"), F.col(f"`{text}`").cast("binary").alias("t"))
    found, each = Scratch(spark), []
    for part in range(SLICES):
        scratch = Scratch(spark)
        own = rows.where(F.pmod("doc.x", F.lit(SLICES)) == part)
        each.append(found.keep(_features(own, table, shared, unseen, start, scratch)))
        scratch.drop()
    out = cut(reduce(DataFrame.union, each))
    found.drop()
    return out


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve (intercept first) over standardised columns by Newton steps with a small ridge; returned for the columns as they are."""
    middle, scale = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate((np.ones((len(x), 1)), (x - middle) / scale), 1)
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (y - p) - 1e-2 * w
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    own = w[1:] / scale
    return np.concatenate(([w[0] - own @ middle], own))


def _found(docs: DataFrame, known: DataFrame, doc_id: str, text: str, train: str) -> DataFrame:
    """The features of each different text, by the models of the labelled rows (known: id, toxic) that count."""
    own = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    # Texts that surely have no label aren't shuffled; labels are as many as documents, so they are never broadcast.
    texts = maybe_in(own.where(train).where("id is not null and text is not null"), known.where(train), "id")
    labelled = spread_join(texts, known.where(train).hint("merge"), "id").select("text", "toxic")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    table, unseen, start = evidence_table(labelled, scratch)
    model = cache(table, ("ratio", "after"))
    name, path = f"evidence_{uuid.uuid4().hex}", new_path(spark, "evidence")
    try:
        dealt = bucketed(table.drop("n"), name, path)
        scratch.drop()
        return features(docs, text, dealt, model, unseen, start)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        delete(spark, path)


def _fitted(docs: DataFrame, known: DataFrame, found: DataFrame, doc_id: str, text: str, calibrate: str):
    """At most about `MOST_ROWS` rows that fit the curve, with their label toxic and features, by a hash of their id."""
    n = known.where(calibrate).count()
    part = int(min(1.0, MOST_ROWS / max(n, 1)) * (1 << 30))
    taken = known.where(calibrate).where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < part)
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), _doc(text).alias("doc")).where(calibrate)
    sample = spread_join(spread_join(rows, taken.hint("merge"), "id"), found, "doc", "left").select("id", "toxic", *[F.coalesce(f, F.lit(0.0)).alias(f) for f in FEATURES])
    return sample.orderBy(F.xxhash64("id"), "id", "toxic").limit(2 * MOST_ROWS).toPandas()


def score(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", train: str | None = None, calibrate: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Per document `__row` (struct of the kept columns), score (probability of toxicity) and the features.

    labels has doc_id and toxic. train and calibrate are SQL conditions over the document's id (a bigint named `id`):
    rows that count and rows that fit the curve.
    """
    spark = docs.sparkSession
    crc = "crc32(cast(cast(id as string) as binary)) % 5"
    train, calibrate = train or f"{crc} in (1, 2, 3)", calibrate or f"{crc} = 4"
    known = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null").distinct()
    with shuffles_freed(spark):
        found = _found(docs, known, doc_id, text, train)
        fitted = _fitted(docs, known, found, doc_id, text, calibrate)
    y = (fitted["toxic"].to_numpy() > 0).astype(float)
    if 0 < y.sum() < len(y):
        w = fit_curve(fitted[list(FEATURES)].to_numpy(float), y)
    else:
        rate = known.where(train).agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0
        w = np.concatenate(([np.log((rate + 1e-3) / (1 - rate + 1e-3))], np.zeros(len(FEATURES))))
    line = F.lit(float(w[0]))
    for f, x in zip(FEATURES, w[1:], strict=True):
        line = line + F.coalesce(f, F.lit(0.0)) * float(x)
    scores = found.select("doc", *FEATURES)

    names = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0).alias("none"))
    joined = spread_join(docs.select(row.alias(ROW), _doc(text).alias("doc")), scores, "doc", "left")
    return joined.select(ROW, *[F.coalesce(f, F.lit(0.0)).alias(f) for f in FEATURES], (1 / (1 + F.exp(-line))).alias("score"))


def reject_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **names) -> DataFrame:
    """The documents whose score is below the threshold."""
    found = score(docs, labels, **names)
    return found.where(F.col("score") < threshold).select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns])


def op9(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, labels, keep=["doc_id"])
    own = F.col(f"{ROW}.doc_id")
    return found.select(
        own.alias("doc_id"),
        F.coalesce(F.pmod(F.crc32(own.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
    )
