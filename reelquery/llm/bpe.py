"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes cuts each text into chunks of about a kilobyte at places that depend on nearby content
only, so equal passages fall into equal chunks wherever they stand. Each worker encodes a chunk once and keeps what it
encoded, within a bound of bytes; documents that share the chunk reuse it. A chunk's first and last part touch its
neighbours: at every join, the last part of one chunk and the first part of the next are encoded again as one text,
from a place that is certainly a token boundary to the next such place (see `pieces`); a chunk without such a place
lengthens the join. The encoding on both sides of a certain boundary doesn't depend on what lies beyond it, so the
repaired ids agree exactly with those of the whole text. Inside a new chunk, words that the worker has met are reused.

Scale: one pass, no shuffle, memory bounded by `CHUNK_BYTES` and by the pieces kept. Copies that meet in different workers are
encoded once in each: a global table of chunks would cost a shuffle of all ids.

Defined results: null and empty texts, and texts of white space, have no ids and decode to the empty string; bytes that
are no UTF-8 count as U+FFFD; repeated rows and columns of any name are carried along; an empty table stays empty.
The tokenizer must drop white space between words (word_bpe_49k.json does) and have no decoder: tokens are then
joined by spaces, as the library's decode does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.llm.common import ROW, carried, groups
from reelquery.llm.pieces import Pieces, cuts, default_path, valid
from reelquery.llm.worker import remembered

#: Chunks have 256 to 8192 bytes, 1 KB more than the least on average.
LEAST, MOST, MASK = 256, 8192, 1023
#: A worker keeps encoded chunks of at most so many bytes; beyond, it starts anew.
CHUNK_BYTES = 32 << 20
_GEAR = np.array([(i * 0x9E3779B1 ^ (i * 0x85EBCA6B >> 7)) * 0xC2B2AE35 & 0xFFFFFFFF for i in range(1, 257)], np.uint32)


def candidates(data: bytes) -> np.ndarray:
    """Places (after a byte) where the rolling hash of the last 16 bytes asks for a cut."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):
        if len(h) > step:
            h[step:] += h[:-step].copy() << np.uint32(step)
    return np.flatnonzero((h >> np.uint32(6)) & np.uint32(MASK) == 0) + 1


def chunks(data: bytes) -> list[bytes]:
    """The text as content-defined chunks."""
    if len(data) <= LEAST:
        return [data] if data else []
    out, start = [], 0
    for at in candidates(data).tolist():
        while at - start > MOST:
            out.append(data[start : start + MOST])
            start += MOST
        if at - start >= LEAST:
            out.append(data[start:at])
            start = at
    while len(data) - start > MOST:
        out.append(data[start : start + MOST])
        start += MOST
    if start < len(data):
        out.append(data[start:])
    return out


class Reuse:
    """What a worker has encoded: chunks, and pieces of text they are made of."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        #: chunk -> (its head, its tail, the ids between), or None if it has no certain boundary
        self.chunks: dict[bytes, tuple[bytes, bytes, np.ndarray] | None] = {}
        self.held = 0
        size = self.pieces.tokenizer.get_vocab_size()
        self.decimal = [str(i).encode() for i in range(size)]
        self.token = [(self.pieces.tokenizer.id_to_token(i) or "").encode() for i in range(size)]

    def add(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.held > CHUNK_BYTES:
            self.chunks.clear()
            self.held = 0
        # A special token may lie across chunks; texts that can hold one are cut at spaces only, as a whole.
        cut = [[] if b"<|" in x else chunks(x) for x in texts]
        self._encode_chunks({c for doc in cut for c in doc if c not in self.chunks})
        plans: list[list] = []
        joins: list[bytes] = []
        for text, doc in zip(texts, cut, strict=True):
            plan, left = [], b"" if doc else text
            for c in doc:
                known = self.chunks[c]
                if known is None:  # the join goes on
                    left += c
                    continue
                joins.append(left + known[0])
                plan += [None, known[2]]
                left = known[1]
            joins.append(left)
            plan.append(None)
            plans.append(plan)
        repaired = iter(self.pieces.ids(joins))
        return [np.concatenate([next(repaired) if x is None else x for x in plan]) for plan in plans]

    def _encode_chunks(self, new: set[bytes]) -> None:
        own = list(new)
        inner = []
        for c in own:
            at = cuts(c, False)
            at = at[(at >= 2) & (at <= len(c) - 2)]  # decided by the chunk's own bytes
            inner.append((int(at[0]), int(at[-1])) if len(at) else None)
        ids = iter(self.pieces.ids([c[p[0] : p[1]] for c, p in zip(own, inner, strict=True) if p]))
        for c, p in zip(own, inner, strict=True):
            if p is None:
                self.chunks[c] = None
                self.held += len(c) + 100
            else:
                self.chunks[c] = (c[: p[0]], c[p[1] :], next(ids))
                self.held += len(c) + 4 * len(self.chunks[c][2]) + 400


def _run(path: str, want: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse = remembered(("chunks", path), lambda: Reuse(path))
        for batch in batches:
            texts = [valid(x.as_py()) for x in batch.column(1)]
            for i, j in groups(texts, 2 << 20):
                out: dict[str, list] = {k: [] for k in want}
                for ids in reuse.add(texts[i:j]):
                    own = ids.tolist()
                    for k in want:
                        out[k].append(_wanted(k, reuse, ids, own))
                arrays = [pa.array(out[k], _TYPES[k][1]) for k in want]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *arrays], names=[ROW, *want])

    return run


def _wanted(kind: str, reuse: Reuse, ids: np.ndarray, own: list[int]):
    if kind == "n_tokens":
        return len(own)
    if kind == "ids":
        return ids
    if kind == "ids_sha256":
        return hashlib.sha256(b" ".join(map(reuse.decimal.__getitem__, own))).hexdigest()
    decoded = b" ".join(map(reuse.token.__getitem__, own))
    return decoded.decode() if kind == "decoded" else hashlib.sha256(decoded).hexdigest()


_TYPES = {"n_tokens": ("bigint", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def encode(docs: DataFrame, *, text: str = "text", path: str | None = None, keep: list[str] | None = None, want: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Per document `__row` (struct of the kept columns) and what is wanted of n_tokens, ids, decoded, ids_sha256 (of decimal ids joined by one space) and decoded_sha256."""
    path = path or default_path("word_bpe_49k.json")
    rows = carried(docs, text, docs.columns if keep is None else keep)
    kind = rows.schema[ROW].dataType.simpleString()
    return rows.mapInArrow(_run(path, want), f"{ROW} {kind}, " + ", ".join(f"{k} {_TYPES[k][0]}" for k in want))


def op7(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    want = ("n_tokens", "ids_sha256", "decoded_sha256")
    return encode(docs, path=path, keep=["doc_id"], want=want).select(F.col(f"{ROW}.doc_id").alias("doc_id"), *want)
