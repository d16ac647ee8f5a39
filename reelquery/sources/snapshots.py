"""Tables that change by whole snapshots: immutable parts, and versions that name the parts which belong to them.

A table is a folder with `parts/<id>` (Parquet, written once) and `_versions/<number>/manifest.json`. A commit writes its
manifest in a folder of its own and renames that folder to the next version: one atomic rename decides which of several
writers gets the number, the others see the new version and try again on top of it. Readers take the latest version and
read its parts; what they began to read stays until `vacuum`, so a reader never meets a table that is half replaced or
absent. A writer that dies leaves a part that no version names. The store needs an atomic rename of folders (HDFS and
local file systems have it).

A table with a key holds the last row of each key by the column `at` (of equal ones the one committed later): `upsert` adds a
part, `read` merges what parts have, and parts of a level are rewritten into one of the next when there are `FAN` of them,
so that every row is rewritten a few times only and no read merges more than some parts of each level.

Batches of streams carry a name and a number: a batch that runs again finds its number in the table and adds nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DateType, IntegerType, LongType, ShortType, StringType, StructType, TimestampNTZType

#: So many parts of one level become one part of the next.
FAN = 8
_EMPTY = {"id": "", "schema": None, "key": None, "at": None, "parts": [], "streams": {}}


class Conflict(Exception):
    """What a commit was built on has changed."""


class Table:
    """A snapshot table at a path of a store that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    # Versions

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        where = self._path("_versions")
        if not self._fs.exists(where):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(where) if s.getPath().getName().isdigit())

    def version(self) -> int:
        """The number of the latest version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        return self._text(f"_versions/{v:010d}/manifest.json") if v else dict(_EMPTY)

    def _text(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, version: int, manifest: dict) -> bool:
        """Makes the manifest that version, unless another writer has it."""
        own = uuid.uuid4().hex
        beside = f".{own}"
        out = self._fs.create(self._path(f"_versions/{beside}/manifest.json"), False)
        out.write(bytearray(json.dumps(manifest | {"id": own}).encode()))
        out.close()
        name = f"_versions/{version:010d}"
        if not self._fs.exists(self._path(name)):
            self._fs.rename(self._path(f"_versions/{beside}"), self._path(name))
        won = self._text(f"{name}/manifest.json")["id"] == own
        if not won:
            for left in (f"_versions/{beside}", f"{name}/{beside}"):  # a rename to a folder that is there moves into it
                self._fs.delete(self._path(left), True)
        return won

    def commit(self, change: Callable[[dict], dict | None]) -> int:
        """Commits change(latest manifest) as the next version, again and again until no other writer was faster; None changes nothing."""
        while True:
            v = self.version()
            new = change(self.manifest(v))
            if new is None:
                return v
            if self._put(v + 1, new):
                return v + 1

    # Parts

    def _write(self, df: DataFrame, stats: tuple[str, ...] = (), level: int = 0) -> dict:
        """Writes a part; stats: columns whose least and greatest value the manifest keeps."""
        name = f"parts/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        kinds = {f.name: f.dataType for f in df.schema.fields}
        some = [c for c in stats if isinstance(kinds[c], LongType | IntegerType | ShortType | ByteType | StringType | DateType | TimestampNTZType)]
        back = self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")
        plain = lambda c: F.col(f"`{c}`") if isinstance(kinds[c], LongType | IntegerType | ShortType | ByteType) else F.col(f"`{c}`").cast("string")
        r = back.agg(F.count(F.lit(1)), *[f(plain(c)) for c in some for f in (F.min, F.max)], *[F.count_if(F.col(f"`{c}`").isNull()) for c in some]).first()
        spans = {c: [r[1 + 2 * i], r[2 + 2 * i], r[1 + 2 * len(some) + i]] for i, c in enumerate(some)}
        return {"path": name, "rows": r[0], "level": level, "spans": spans}

    def _read(self, parts: list[dict], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p['path']}" for p in parts])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the latest by default); of a table with a key, the last row of each."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise FileNotFoundError(f"{self.path} has no version")
        schema = StructType.fromJson(m["schema"])
        if not m["parts"]:
            return self.spark.createDataFrame([], schema)
        if not m["key"] or len(m["parts"]) == 1:
            return self._read(m["parts"], schema)
        return self._merged(m["parts"], schema, m["key"], m["at"])

    def _merged(self, parts: list[dict], schema: StructType, key: str, at: str) -> DataFrame:
        every = None
        for i, p in enumerate(parts):
            own = self._read([p], schema).withColumn("__part", F.lit(i))
            every = own if every is None else every.unionAll(own)
        return last_rows(every, key, F.struct(F.col(f"`{at}`"), F.col("__part")), schema.names)

    # Writers

    def replace(self, df: DataFrame) -> int:
        """All rows at once: readers see the table as it was, or the new one."""
        part = self._write(df)
        return self.commit(lambda m: m | {"schema": df.schema.jsonValue(), "key": None, "at": None, "parts": [part]})

    def append(self, df: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """Adds rows, each batch of a stream once."""
        if self._done(self.manifest(), stream, batch):
            return self.version()
        part = self._write(df)
        out = self.commit(lambda m: None if self._done(m, stream, batch) else self._added(m, df.schema, part, stream, batch))
        self.settle()
        return out

    def append_new(self, df: DataFrame, key: str, stream: str | None = None, batch: int | None = None, at: str | None = None, within: int | None = None) -> int:
        """Adds one row of each key that the table doesn't have (null is a key); each batch of a stream once.

        Only parts whose range of keys meets that of the new rows are looked at, and of them the key alone. With `at` (a bigint)
        and `within`, a key that comes again does so at most `within` after it came first, and older parts aren't looked at.
        """
        c, kind = F.col(f"`{key}`"), df.schema[key].dataType
        shown = c if isinstance(kind, LongType | IntegerType | ShortType | ByteType) else c.cast("string")
        r = df.agg(F.min(shown), F.max(shown), F.count_if(c.isNull()), *([F.min(at)] if at else [])).first()
        oldest = r[3] - within if at and within is not None and r[3] is not None else None

        def meets(part: dict) -> bool:
            lo, hi, nulls = part["spans"].get(key, (None, None, None))
            when = part["spans"].get(at, (None, None, 1)) if at else (None, None, 1)
            if oldest is not None and when[1] is not None and not when[2] and when[1] < oldest:
                return False
            if nulls is None or nulls and r[2]:
                return True
            return lo is not None and r[0] is not None and not (hi < r[0] or r[1] < lo)

        while True:
            base = self.manifest()
            if self._done(base, stream, batch):
                return self.version()
            new = df.dropDuplicates([key])
            if met := [p for p in base["parts"] if meets(p)]:
                known = self._read(met, StructType.fromJson(base["schema"])).select(c.alias("__known"))
                new = new.join(known, c.eqNullSafe(F.col("__known")), "left_anti")
            part = self._write(new, (key, at) if at else (key,))
            seen = {p["path"] for p in base["parts"]}

            def change(m: dict) -> dict | None:
                if self._done(m, stream, batch):
                    return None
                if any(p["path"] not in seen and meets(p) for p in m["parts"]):
                    raise Conflict
                return self._added(m, df.schema, part, stream, batch)  # noqa: B023

            try:
                out = self.commit(change)
            except Conflict:
                self._fs.delete(self._path(part["path"]), True)
                continue
            self.settle()
            return out

    def upsert(self, df: DataFrame, key: str, at: str, stream: str | None = None, batch: int | None = None) -> int:
        """Puts the last row of each key; each batch of a stream once."""
        base = self.manifest()
        if self._done(base, stream, batch):
            return self.version()
        if base["schema"] is not None and (base["key"], base["at"]) != (key, at):
            raise ValueError(f"the table's key is {base['key']} by {base['at']}")
        part = self._write(last_rows(df, key, F.col(f"`{at}`"), df.columns))
        out = self.commit(lambda m: None if self._done(m, stream, batch) else self._added(m, df.schema, part, stream, batch) | {"key": key, "at": at})
        self.settle()
        return out

    @staticmethod
    def _done(m: dict, stream: str | None, batch: int | None) -> bool:
        return stream is not None and m["streams"].get(stream, -1) >= batch

    @staticmethod
    def _added(m: dict, schema: StructType, part: dict, stream: str | None, batch: int | None) -> dict:
        streams = m["streams"] if stream is None else m["streams"] | {stream: batch}
        return m | {"schema": m["schema"] or schema.jsonValue(), "parts": [*m["parts"], part] if part["rows"] else m["parts"], "streams": streams}

    def settle(self) -> None:
        """Rewrites the last parts into one where there are FAN of a level, level by level."""
        while True:
            m = self.manifest()
            level = m["parts"][-1]["level"] if m["parts"] else 0
            run = len(m["parts"])
            while run and m["parts"][run - 1]["level"] == level:
                run -= 1
            old = m["parts"][run:]
            if len(old) < FAN:
                return
            schema = StructType.fromJson(m["schema"])
            rows = self._merged(old, schema, m["key"], m["at"]) if m["key"] else self._read(old, schema)
            part = self._write(rows.coalesce(max(1, sum(p["rows"] for p in old) // 1_000_000)) if not m["key"] else rows, tuple(old[0]["spans"]), level + 1)
            names = {p["path"] for p in old}

            def change(m: dict) -> dict | None:
                here = [i for i, p in enumerate(m["parts"]) if p["path"] in names]  # noqa: B023
                if len(here) < len(names):  # noqa: B023
                    return None  # another writer has rewritten some of them
                return m | {"parts": [*m["parts"][: here[0]], part, *m["parts"][here[-1] + 1 :]]}  # noqa: B023

            self.commit(change)

    def vacuum(self, keep: int = 2, older_than: float = 3600.0) -> int:
        """Deletes versions but the last `keep`, and parts that none of those names and that are older than so many seconds; returns how many parts."""
        every = self.versions()
        live = {p["path"] for v in every[-keep:] for p in self.manifest(v)["parts"]}
        for v in every[:-keep]:
            self._fs.delete(self._path(f"_versions/{v:010d}"), True)
        gone, until = 0, (time.time() - older_than) * 1000
        if self._fs.exists(self._path("parts")):
            for s in self._fs.listStatus(self._path("parts")):
                if f"parts/{s.getPath().getName()}" not in live and s.getModificationTime() < until:
                    self._fs.delete(s.getPath(), True)
                    gone += 1
        return gone


def last_rows(df: DataFrame, key: str, order, names: list[str]) -> DataFrame:
    """The row of each key with the greatest order (a null order only if there is no other), aggregated before it is shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    found = df.groupBy(F.col(f"`{key}`").alias("__key")).agg(F.max_by(row, F.struct(order, F.lit(0))).alias("__row"))
    return found.select(*[F.col(f"__row.`{c}`").alias(c) for c in names])
