"""A filter of bounded size that tells most keys that aren't in a set, so that only the others are shuffled to meet it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.llm.worker import tidy

#: Bits of a filter: 8 MB, whatever it stands for.
FILTER_BITS = 1 << 26
#: Numbers of 64 bits of a filter that a row of `PackedBits` holds.
ROW_NUMBERS = 1 << 13


class Bits:
    """Three bits for each key of a frame (a bigint column k). Keys that aren't in it may be taken for such that are, never the other way round; with more keys than bits it lets everything through."""

    def __init__(self, keys: DataFrame):
        first = F.col("k").bitwiseAND(FILTER_BITS - 1)
        second = F.shiftrightunsigned("k", 32).bitwiseAND(FILTER_BITS - 1)
        third = F.shiftrightunsigned("k", 7).bitwiseXOR(F.shiftrightunsigned("k", 45)).bitwiseAND(FILTER_BITS - 1)
        bit = keys.select(F.explode(F.array(first, second, third)).alias("b"))
        marks = bit.groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits")).toArrow()
        self.bits = np.zeros(max(FILTER_BITS >> 6, 1), np.int64)
        self.bits[marks["at"].to_numpy()] = marks["bits"].to_numpy()

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Indexes of the keys that may be in it."""
        at = np.flatnonzero(self._has(keys))
        u = keys.view(np.uint64)
        at = at[self._has((u[at] >> np.uint64(32)).view(np.int64))]
        return at[self._has(((u[at] >> np.uint64(7)) ^ (u[at] >> np.uint64(45))).view(np.int64))]

    def _has(self, keys: np.ndarray) -> np.ndarray:
        b = keys & (64 * len(self.bits) - 1)
        return (self.bits[b >> 6] >> (b & 63)) & 1 == 1


class PackedBits(Bits):
    """The same bits for frames of many keys: each task sets its own and ships them compressed, about a byte for each."""

    def __init__(self, keys: DataFrame):
        rows = keys.select("k").mapInArrow(tidy(_packed(max(FILTER_BITS >> 6, 1), FILTER_BITS - 1)), "at long, bits binary")
        found = rows.groupBy("at").applyInArrow(_either, "at long, bits binary").toArrow()
        self.bits = np.zeros(max(FILTER_BITS >> 6, 1), np.int64)
        for at, x in zip(found["at"].to_pylist(), found["bits"].to_pylist(), strict=True):
            own = np.frombuffer(zlib.decompress(x), np.int64)
            self.bits[at : at + len(own)] = own


def _packed(size: int, last: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.int64)
        for batch in batches:
            k = batch.column(0).to_numpy()
            u = k.view(np.uint64)
            third = ((u >> np.uint64(7)) ^ (u >> np.uint64(45))).view(np.int64)
            b = np.unique(np.concatenate((k, (u >> np.uint64(32)).view(np.int64), third)) & last)
            if len(b):
                at = b >> 6
                heads = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                bits[at[heads]] |= np.bitwise_or.reduceat(np.int64(1) << (b & 63), heads)
        for at in range(0, size, ROW_NUMBERS):
            own = bits[at : at + ROW_NUMBERS]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([zlib.compress(own.tobytes(), 1)])], names=["at", "bits"])

    return run


def _either(rows: pa.Table) -> pa.Table:
    """One row of the bits that any of the rows, all of one place, has."""
    bits = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), np.int64) for x in rows["bits"].to_pylist()])
    return pa.table({"at": rows["at"].slice(0, 1).combine_chunks(), "bits": pa.array([zlib.compress(bits.tobytes(), 1)])})


def _run(shared, then):
    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(shared.value.places(batch.column(0).to_numpy()))).select(batch.schema.names[1:])

    return lambda batches: then(some(batches)) if then else some(batches)


def maybe_in(rows: DataFrame, keys: DataFrame, column: str, then=None, schema: str | None = None) -> DataFrame:
    """The rows whose column (a bigint without nulls) may be among the keys' column of that name; none that is goes. `then` goes on with their batches in the same worker and gives rows of `schema`."""
    hashed = F.xxhash64(column).alias("k")
    shared = rows.sparkSession.sparkContext.broadcast(Bits(keys.select(hashed)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.select(hashed, *[f"`{c}`" for c in rows.columns]).mapInArrow(tidy(_run(shared, then)), schema or fields)
