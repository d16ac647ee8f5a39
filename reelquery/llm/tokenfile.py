"""Token files: ids in Re-Pair compressed blocks that any document, or any token of one, can be read from.

Documents are dealt to shards by ranges of their id and sorted. Each shard is written as blocks of about a million
ids. In a block, the most frequent pairs of neighbouring ids are replaced by nonterminals, round after round until no
pair occurs `OFTEN` times, below which a rule hardly pays for itself, or 16-bit symbols are used up (a vocabulary beyond 16
bits has 32-bit symbols). A pair never reaches across two documents, so a document is a run of symbols.

Format, one row a block in Parquet: part and block (the order), n_docs, n_tokens, start (ids of the part before the
block), base (the first nonterminal), rules (pairs of little-endian uint32: nonterminal base+k is rules[k]), lengths
(uint32: how many ids each nonterminal expands to), symbols (uint16 if `width` is 2, else uint32), doc_ids, doc_tokens
(ids of each document), doc_symbols (symbols of each document). `read_document` needs the doc_symbols and lengths to
find a document and expands nothing else.

Scale: one range exchange of (id, text); blocks are written by Spark's own writer and commit protocol, so a lost
executor leaves no half file; Python holds one block. The ids before each part come from one row a part on the
driver (as many as partitions, never as many as documents).

Defined results: null text is empty and has the end id only; null ids sort first; documents that share an id keep an
order by their text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.llm.common import groups, new_path, shuffle_partitions
from reelquery.llm.pieces import Pieces, default_path, spread, valid
from reelquery.llm.worker import remembered

#: Ids in a block, pairs replaced in a round at most, and how often a pair must occur: a rule takes 12 bytes (with its length) and saves 2 for each time it is used.
BLOCK, PAIRS, OFTEN = 1_000_000, 4096, 16

BLOCK_SCHEMA = "part int, block int, n_docs int, n_tokens bigint, start bigint, base int, width int, rules binary, lengths binary, symbols binary, doc_ids array<bigint>, doc_tokens array<bigint>, doc_symbols array<bigint>"
_ARROW = {"part": pa.int32(), "block": pa.int32(), "n_docs": pa.int32(), "n_tokens": pa.int64(), "start": pa.int64(), "base": pa.int32(), "width": pa.int32(), "rules": pa.binary(), "lengths": pa.binary(), "symbols": pa.binary(), "doc_ids": pa.list_(pa.int64()), "doc_tokens": pa.list_(pa.int64()), "doc_symbols": pa.list_(pa.int64())}


def compress(ids: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (rules as pairs, symbols, symbols of each document). ends: ids up to the end of each document."""
    sym = ids.astype(np.uint32)
    final = np.zeros(len(sym), np.bool_)  # nothing that ends a document is the left of a pair
    final[ends[ends > 0] - 1] = True
    rules: list[np.ndarray] = []
    count = 0
    most = max(0, 65_536 - base) if base <= 65_536 else 1 << 20
    while len(sym) > 1 and count < most:
        left, right = sym[:-1], sym[1:]
        if base + most <= 65_536:  # a pair fits 32 bits, which sort twice as fast
            code = (left << np.uint32(16)) | right
        else:
            code = (left.astype(np.uint64) << np.uint64(32)) | right
        order = np.sort(code[~final[:-1]])
        heads = np.flatnonzero(order[1:] != order[:-1]) + 1
        heads = np.concatenate((np.zeros(min(1, len(order)), np.int64), heads))
        often = np.diff(np.concatenate((heads, [len(order)])))
        good = often >= OFTEN
        values, often = order[heads[good]], often[good]
        if not len(values):
            break
        room = min(PAIRS, most - count)
        if len(values) > room:
            top = np.sort(np.argsort(-often, kind="stable")[:room])
            values = values[top]
        # A table of hashes leaves few places for the exact test; where several pairs share a hash, they are searched.
        numbers = np.arange(len(values), dtype=np.int32)
        fold = _fold(values)
        table = np.full(1 << 16, -1, np.int32)
        table[fold] = numbers
        table[fold[table[fold] != numbers]] = -2
        slot = table[_fold(code)]
        slot[final[:-1]] = -1
        maybe = np.flatnonzero(slot != -1)
        slot, own = slot[maybe], code[maybe]
        several = np.flatnonzero(slot == -2)
        slot[several] = np.minimum(np.searchsorted(values, own[several]), len(values) - 1)
        exact = values[slot] == own
        maybe, slot = maybe[exact], slot[exact]
        # In a run of overlapping hits every second one is replaced, from the left.
        run = np.concatenate(([True], np.diff(maybe) != 1))
        first = maybe[run][np.cumsum(run) - 1]
        taken = (maybe - first) % 2 == 0
        at, slot = maybe[taken], slot[taken]
        there = np.bincount(slot, minlength=len(values)) > 0
        used = np.flatnonzero(there)
        sym[at] = (base + count - 1 + np.cumsum(there)).astype(np.uint32)[slot]
        final[at] = final[at + 1]
        stay = np.ones(len(sym), np.bool_)
        stay[at + 1] = False
        sym, final = sym[stay], final[stay]
        half = np.uint64(16 if code.dtype == np.uint32 else 32)
        chosen = values[used].astype(np.uint64)
        rules.append(np.stack([(chosen >> half).astype(np.uint32), (chosen & ((np.uint64(1) << half) - np.uint64(1))).astype(np.uint32)], 1))
        count += len(used)
    places = np.flatnonzero(final) + 1
    return np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), sym, np.diff(np.concatenate(([0], places)))


def _fold(code: np.ndarray) -> np.ndarray:
    return ((code * code.dtype.type(0x9E3779B1)) >> code.dtype.type(8)).astype(np.uint16)


def lengths_of(rules: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(rules), np.uint32)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = (1 if a < base else out[a - base]) + (1 if b < base else out[b - base])
    return out


def expansions(rules: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids that the nonterminals stand for, one after the other, and where each starts."""
    starts = np.cumsum(lengths.astype(np.int64)) - lengths
    flat = np.zeros(int(lengths.sum()), np.uint32)
    at, size = starts.tolist(), lengths.tolist()
    for k, (a, b) in enumerate(rules.tolist()):
        s = at[k]
        n = 1 if a < base else size[a - base]
        flat[s : s + n] = a if a < base else flat[at[a - base] : at[a - base] + n]
        m = size[k] - n
        flat[s + n : s + n + m] = b if b < base else flat[at[b - base] : at[b - base] + m]
    return flat, starts


class Block:
    """One block read back."""

    def __init__(self, base: int, width: int, rules: bytes, lengths: bytes, symbols: bytes):
        self.base = base
        self.rules = np.frombuffer(rules, "<u4").reshape(-1, 2)
        self.lengths = np.frombuffer(lengths, "<u4")
        self.symbols = np.frombuffer(symbols, "<u2" if width == 2 else "<u4")
        self._flat = None

    def expand(self, first: int, count: int) -> np.ndarray:
        """The ids of `count` symbols from the symbol `first` on."""
        if self._flat is None:
            flat, starts = expansions(self.rules, self.lengths, self.base)
            # The ids of terminals are the symbols themselves; they follow the expansions.
            self._flat, self._starts = flat, starts
        sym = self.symbols[first : first + count].astype(np.int64)
        rule = sym >= self.base
        sizes = np.ones(len(sym), np.int64)
        sizes[rule] = self.lengths[sym[rule] - self.base]
        out = np.zeros(int(sizes.sum()), np.uint32)
        ends = np.cumsum(sizes)
        out[(ends - sizes)[~rule]] = sym[~rule]
        runs = sizes[rule]
        out[spread((ends - sizes)[rule], runs)] = self._flat[spread(self._starts[sym[rule] - self.base], runs)]
        return out

    def documents(self, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sizes of all documents (of so many symbols each), and all their ids."""
        sizes = np.ones(len(self.symbols), np.int64)
        sym = self.symbols.astype(np.int64)
        rule = sym >= self.base
        sizes[rule] = self.lengths[sym[rule] - self.base]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        return np.diff(upto[np.concatenate(([0], np.cumsum(per)))]), self.expand(0, len(self.symbols))

    def token(self, first: int, count: int, k: int) -> int:
        """The k-th id of a document that has `count` symbols from `first` on: goes down the rules and expands nothing."""
        sym = self.symbols[first : first + count].astype(np.int64)
        sizes = np.ones(len(sym), np.int64)
        rule = sym >= self.base
        sizes[rule] = self.lengths[sym[rule] - self.base]
        ends = np.cumsum(sizes)
        i = int(np.searchsorted(ends, k, side="right"))
        k -= int(ends[i] - sizes[i])
        s = int(sym[i])
        while s >= self.base:
            a, b = (int(x) for x in self.rules[s - self.base])
            n = 1 if a < self.base else int(self.lengths[a - self.base])
            s, k = (a, k) if k < n else (b, k - n)
        return s


def _write(path: str, end_id: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = remembered(("pieces", path), lambda: Pieces(path))
        base = max(encoder.tokenizer.get_vocab_size(), end_id + 1)
        part = TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        keys: list[int | None] = []
        held = number = start = 0

        def close() -> pa.RecordBatch:
            nonlocal held, number, start, ids, keys
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            rules, symbols, per = compress(np.concatenate(ids), np.cumsum(sizes), base)
            width = 2 if base + len(rules) <= 65_536 else 4
            row = {"part": part, "block": number, "n_docs": len(ids), "n_tokens": held, "start": start, "base": base, "width": width, "rules": rules.astype("<u4").tobytes(), "lengths": lengths_of(rules, base).astype("<u4").tobytes(), "symbols": symbols.astype("<u2" if width == 2 else "<u4").tobytes(), "doc_ids": keys, "doc_tokens": sizes, "doc_symbols": per}
            start, number = start + held, number + 1
            held, ids, keys = 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([v], _ARROW[k]) for k, v in row.items()], names=list(row))

        end = np.array([end_id], np.int32)
        for batch in batches:
            texts = [valid(x.as_py()) for x in batch.column(1)]
            own = batch.column(0).to_pylist()
            for i, j in groups(texts, 2 << 20):
                for key, x in zip(own[i:j], encoder.ids(texts[i:j]), strict=True):
                    ids.append(np.concatenate((x, end)))
                    keys.append(key)
                    held += len(x) + 1
                if held >= block:
                    yield close()
        if ids:
            yield close()

    return run


def write_tokens(docs: DataFrame, out: str, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 2, block: int = BLOCK) -> None:
    """Encodes every text, appends `end_id`, and writes the ids in ascending order of the documents' ids as token files in the folder `out`."""
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("k"), F.col(f"`{text}`").cast("binary").alias("t"))
    rows = rows.repartitionByRange(n, F.col("k"), F.xxhash64("t")).sortWithinPartitions("k", F.xxhash64("t"))
    rows.mapInArrow(_write(path or default_path("byte_bpe_50k.json"), end_id, block), BLOCK_SCHEMA).write.parquet(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1).to_pylist()[0]
            b = Block(row["base"], row["width"], row["rules"], row["lengths"], row["symbols"])
            sizes, ids = b.documents(np.array(row["doc_symbols"], np.int64))
            ends = np.cumsum(sizes)
            data = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate(([0], 4 * ends)).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["at"] + row["start"] + ends - sizes), pa.array(sizes), data], names=["doc_id", "start", "n_tokens", "ids"])


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _read(batches):
        crc = [zlib.crc32(x.as_py()) for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def blocks_at(spark: SparkSession, out: str) -> DataFrame:
    """The blocks of token files with `at`, the ids before their part."""
    blocks = spark.read.parquet(out)
    parts = sorted((r[0], r[1]) for r in blocks.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, at = [], 0
    for part, n in parts:
        before.append((part, at))
        at += n
    offsets = spark.createDataFrame(before, "part int, at bigint")
    return blocks.join(F.broadcast(offsets) if len(before) <= 100_000 else offsets, "part")


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """All documents of token files: doc_id, start (ids before it), n_tokens, ids (little-endian uint32)."""
    return blocks_at(spark, out).mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def read_document(spark: SparkSession, out: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents of that id; only they are expanded."""
    found = []
    for row in spark.read.parquet(out).where(F.array_contains("doc_ids", doc_id)).toLocalIterator():
        b = Block(row["base"], row["width"], row["rules"], row["lengths"], row["symbols"])
        first = 0
        for key, count in zip(row["doc_ids"], row["doc_symbols"], strict=True):
            if key == doc_id:
                found.append(b.expand(first, count).tolist())
            first += count
    return found


def op4(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    out = new_path(spark, "tokens")
    write_tokens(docs, out, path=path)
    return blocks_at(spark, out).mapInArrow(_crc, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
