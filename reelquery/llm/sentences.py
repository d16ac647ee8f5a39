"""Substring dedup by sliding spans of sentences.

A sentence ends at a line break, or at `.`, `!` or `?` before white space; text without a word belongs to the
sentence before it. From each sentence on, a run of `span` sentences (all, if a document has fewer) grows by further
ones until it has `min_words` words. What the document's end cuts off below `min_words` is no run of its own, but the
last run that has them is also taken up to the end, and a document without any run is one as a whole: so equal documents
of any length are found whole. Runs are hashed by their words, case and punctuation aside. A run's first place is in the document of the smallest id, at its first occurrence
there. All sentences covered by a run elsewhere are removed.

The settings: a passage of some 50 words that begins and ends inside sentences holds few whole ones, so runs are of two;
lines that many documents share have up to 20 words or so, so a run has 28 at least. Both numbers were chosen among eight
settings by measurement on synthetic documents (see the README for the figures on those and on others).

Scale: the runs of each document are hashed once and written; one row per distinct run hash of a document goes through
an aggregation (smallest and largest id of each hash) and a join that splits hot hashes; then each document with
removals gets its own hashes back, and only such texts are hashed again. Texts are shuffled once.

Defined results: null text stays null; empty text has no sentence and stays; rows that share an id are one document
(its runs repeat within it only, and each row is cleaned alike); documents with a null id are cleaned of runs repeated
within themselves only; columns of any name are carried along; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.llm.common import ROW, Scratch, cut, groups
from reelquery.llm.components import spread_join
from reelquery.llm.words import ALNUM, mix, word_hashes
from reelquery.llm.worker import tidy

#: Sentences in a run; words that a run must have.
SPAN, MIN_WORDS = 2, 28
_END = re.compile(rb"(?<=[.!?])[\x20\t]+|[\r\n]+")
_FACTOR = 0xD6E8FEB86659FD93
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def sentences(data: bytes) -> list[tuple[int, int]]:
    """[start, end) in bytes of each sentence with the white space behind it; together they are the text."""
    cuts = [0, *(m.end() for m in _END.finditer(data)), len(data)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def runs(data: bytes, span: int, min_words: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """The sentences that have words, and the hash of each run with the index of its first sentence and of the one behind it."""
    own: list[tuple[int, int]] = []
    words: list[bytes] = []
    counts: list[int] = []
    low = data.translate(ALNUM)
    for a, b in sentences(data):
        w = low[a:b].split()
        if not w and own:
            own[-1] = (own[-1][0], b)
        elif w:
            own.append((a, b))
            words += w
            counts.append(len(w))
    if not own:
        return own, *[np.zeros(0, np.int64)] * 3
    h = word_hashes(words)
    ends = np.cumsum(counts)
    starts = ends - counts
    # The words' hashes folded into one for each sentence: a sum of terms that depend on the place in the sentence.
    place = np.arange(len(h)) - np.repeat(starts, counts)
    each = np.add.reduceat(mix(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts)
    each = mix(each + np.asarray(counts, np.uint64))
    at = np.arange(len(own))
    behind = np.maximum(at + min(span, len(own)), np.searchsorted(ends, starts + min_words) + 1)
    full = behind <= len(own)
    at, behind = at[full], behind[full]
    if not len(at) or behind[-1] < len(own):
        at, behind = np.append(at, at[-1:] if len(at) else 0), np.append(behind, len(own))
    # A polynomial over the sentences from running sums; the factor's inverse takes the place in the document out.
    sums = np.concatenate(([np.uint64(0)], np.cumsum(each * _powers(_FACTOR, len(own)), dtype=np.uint64)))
    out = (sums[behind] - sums[at]) * _powers(_INVERSE, len(own))[at] + (behind - at).astype(np.uint64)
    return own, mix(out).view(np.int64), at, behind


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def count_sentences(data: bytes) -> int:
    """How many sentences have a word."""
    low = np.frombuffer(data.translate(ALNUM), np.uint8)
    starts = [0, *(m.end() for m in _END.finditer(data) if m.end() < len(data))]
    return int(np.logical_or.reduceat(low != 32, starts).sum())


def _hashes(span: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            for i, j in groups(texts):
                all_runs = [runs(d, span, min_words)[1] if d else np.zeros(0, np.int64) for d in texts[i:j]]
                out = [np.unique(h) for h in all_runs]
                inner = [len(u) < len(h) for u, h in zip(out, all_runs, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(out, pa.list_(pa.int64())), pa.array(inner, pa.bool_())], names=["id", "runs", "repeats"])

    return run


def _clean(span: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts = [x.as_py() for x in batch.column(1)]
            for i, j in groups(all_texts):
                part = batch.slice(i, j - i)
                texts, counts, removed, spans = [], [], [], []
                for data, gone, check in zip(all_texts[i:j], part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    own = [] if not data else cleaned(data, gone, span, min_words) if check else (data, count_sentences(data), 0, [])
                    for column, x in zip((texts, counts, removed, spans), own or (data, 0, 0, []), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=[ROW, "clean", "n_sentences", "n_removed", "spans"])

    return run


def cleaned(data: bytes, gone: list[int] | None, span: int, min_words: int) -> tuple[bytes, int, int, list[list[int]]]:
    """What stays of a text, its sentences, how many of them go, and their spans in code points."""
    own, h, *places = runs(data, span, min_words)
    drop = np.zeros(len(own), np.bool_)
    seen, bad = set(), set(gone or ())
    for x, i, j in zip(h.tolist(), *(p.tolist() for p in places), strict=True):
        if x in bad or x in seen:
            drop[i:j] = True
        seen.add(x)
    if not drop.any():
        return data, len(own), 0, []
    edges = np.flatnonzero(np.diff(np.concatenate(([False], drop, [False])).astype(np.int8))).tolist()
    pieces = [(own[i][0], own[j - 1][1]) for i, j in zip(edges[::2], edges[1::2], strict=True)]
    at_byte, at_point, keep, spans = 0, 0, [], []
    for a, b in pieces:
        keep.append(data[at_byte:a])
        first = at_point + len(keep[-1].decode("utf-8", "replace"))
        at_byte, at_point = b, first + len(data[a:b].decode("utf-8", "replace"))
        spans.append([first, at_point])
    return b"".join([*keep, data[at_byte:]]).rstrip(), len(own), int(drop.sum()), spans


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, min_words: int = MIN_WORDS, keep: list[str] | None = None) -> DataFrame:
    """Per document `__row` (struct of the kept columns), clean (UTF-8 bytes of what stays), n_sentences, n_removed, spans (removed [start, end) in code points)."""
    key = F.col(f"`{doc_id}`").cast("bigint")
    scratch = Scratch(docs.sparkSession)
    found = docs.select(key.alias("id"), F.col(f"`{text}`").cast("binary").alias("t")).where("id is not null and t is not null")
    hashed = scratch.keep(found.mapInArrow(tidy(_hashes(span, min_words)), "id bigint, runs array<bigint>, repeats boolean"))
    each = hashed.select("id", F.explode("runs").alias("run"))
    shared = each.groupBy("run").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("run", "first")
    later = spread_join(each, shared, "run").where("id <> first").select("id", "run").union(hashed.where("repeats").select("id", F.lit(None).cast("bigint")))
    later = cut(later.groupBy(F.col("id").alias("__id")).agg(F.collect_set("run").alias("gone")))
    scratch.drop()
    rows = _rows(docs, doc_id, text, keep)
    kind = rows.schema[ROW].dataType.simpleString()
    check = (F.col("gone").isNotNull() | F.col("__id").isNull()).alias("check")
    # A merge join at every size: documents with removals grow with the data.
    joined = spread_join(rows, later.hint("merge"), "__id", "left").select(ROW, "__text", "gone", check)
    return joined.mapInArrow(tidy(_clean(span, min_words)), f"{ROW} {kind}, clean binary, n_sentences bigint, n_removed bigint, spans array<array<bigint>>")


def _rows(docs: DataFrame, doc_id: str, text: str, keep: list[str] | None) -> DataFrame:
    names = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0).alias("none"))
    return docs.select(row.alias(ROW), F.col(f"`{text}`").cast("binary").alias("__text"), F.col(f"`{doc_id}`").cast("bigint").alias("__id"))


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed (spans in code points), has_repeat, text (what stays)."""
    found = deduplicate(docs, keep=["doc_id"])
    return found.select(
        F.col(f"{ROW}.doc_id").alias("doc_id"),
        "n_sentences",
        "n_removed",
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s[0], s[1])), ",").alias("removed"),
        (F.col("n_removed") > 0).alias("has_repeat"),
        F.col("clean").cast("string").alias("text"),
    )
