"""Matrices in .npy files as a data source: partitions are ranges of rows, read by their byte offset.

`spark.read.format("npy")` after `spark.dataSource.register(NpySource)`, or `jsonl.read_matrix`; `write_matrix` writes a
folder of such files. Files are opened with Arrow's file systems: local and shared paths, file://, s3://, gs:// and
hdfs:// (which needs libhdfs on every node).
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

_SCHEMA = "row bigint, vec array<float>"
#: Rows of a batch, and of a file that is written.
BATCH, FILE_ROWS = 4096, 65536


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path if scheme else path
    return fs.FileSystem.from_uri(path)


def header(stream) -> tuple[np.dtype, int, int, int]:
    """Element type, rows, columns and the offset of the first row of an open .npy file."""
    magic = stream.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("no .npy file")
    wide = magic[6] >= 2
    length = int.from_bytes(stream.read(4 if wide else 2), "little")
    said = ast.literal_eval(stream.read(length).decode("utf-8" if magic[6] >= 3 else "latin-1"))
    if said["fortran_order"] or len(said["shape"]) != 2 or np.dtype(said["descr"]).kind not in "fiu":
        raise ValueError(f"a matrix of numbers in row order is asked for, not {said}")
    return np.dtype(said["descr"]), *said["shape"], 8 + (4 if wide else 2) + length


class Range(InputPartition):
    """Rows start to end of a file, and the number of its first row in the whole matrix."""

    def __init__(self, path: str, first: int, start: int, end: int):
        self.path, self.first, self.start, self.end = path, first, start, end


class NpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def files(self) -> list[str]:
        store, where = open_store(self.path)
        info = store.get_file_info(where)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [where]
        return sorted(i.path for i in store.get_file_info(fs.FileSelector(where)) if i.path.endswith(".npy"))

    def partitions(self) -> list[Range]:
        store, _ = open_store(self.path)
        out, first = [], 0
        for name in self.files():
            with store.open_input_file(name) as f:
                _, n, _, _ = header(f)
            out += [Range(name, first, at, min(n, at + self.rows)) for at in range(0, n, self.rows)]
            first += n
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = open_store(self.path)
        with store.open_input_file(partition.path) as f:
            kind, _, width, offset = header(f)
            for at in range(partition.start, partition.end, BATCH):
                n = min(BATCH, partition.end - at)
                f.seek(offset + at * width * kind.itemsize)
                data = f.read(n * width * kind.itemsize)
                if len(data) < n * width * kind.itemsize:
                    raise ValueError(f"{partition.path} ends before row {at + n}")
                flat = np.frombuffer(data, kind).astype(np.float32)
                ends = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)) if width else pa.array(np.zeros(n + 1, np.int32))
                vec = pa.ListArray.from_arrays(ends, pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first + at, partition.first + at + n)), vec], names=["row", "vec"])


class NpyWriter(DataSourceWriter):
    """A task writes its rows, which come in order of `row`, as files of FILE_ROWS rows named after their first row."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> WriterCommitMessage:
        store, where = open_store(self.path)
        held: list[list[float]] = []
        first = None

        def put() -> None:
            with store.open_output_stream(f"{where}/{first:020d}.npy") as out:
                matrix = np.array(held, dtype="<f4")
                text = repr({"descr": "<f4", "fortran_order": False, "shape": matrix.shape})
                text += " " * (-(10 + len(text) + 1) % 64) + "\n"
                out.write(b"\x93NUMPY\x01\x00" + len(text).to_bytes(2, "little") + text.encode())
                out.write(matrix.tobytes())

        for row in iterator:
            if first is None:
                store.create_dir(where, recursive=True)
                first = row["row"]
            held.append(row["vec"])
            if len(held) == FILE_ROWS:
                put()
                held, first = [], None
        if held:
            put()
        return WriterCommitMessage()


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("rows", FILE_ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"])


def write_matrix(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Writes row, vec (rows contiguous from 0) as a folder of .npy files that `read_matrix` reads in the same order. A task that runs again writes the same files."""
    spark = df.sparkSession
    spark.dataSource.register(NpySource)
    rows = df.selectExpr("cast(row as bigint) AS row", "cast(vec as array<float>) AS vec")
    dealt = rows.repartitionByRange(partitions, "row") if partitions else rows.repartitionByRange("row")
    dealt.sortWithinPartitions("row").write.format("npy").mode("append").save(path)
