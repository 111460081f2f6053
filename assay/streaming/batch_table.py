"""A table that grows by micro-batches, stays small in files, and never shows a row twice.

Rows of a batch go to a folder of their own; an empty file named after the batches that it holds and the folder commits it.
Whenever ``fan_in`` entries of one level stand at the end, a folder with the rows of all of them is written and committed as
one entry of the next level. Readers take the entries that no wider one covers, so the moment the wider one is there, the
narrower ones are not: a reader sees each row once, before, during and after. What was covered is deleted when the next merge
begins, which leaves readers that began earlier that long to end. One query writes to a table.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN_IN = 10
_NAME = re.compile(r"(\d+)-(\d+)-(\d+)-(t[0-9a-f]+)")


@dataclass(frozen=True)
class Entry:
    first: int
    last: int
    level: int
    folder: str

    @property
    def name(self) -> str:
        return f"{self.first}-{self.last}-{self.level}-{self.folder}"


class BatchTable:
    """``keys`` are partition columns, ``merge`` reduces the rows of several entries (as they are by default)."""

    def __init__(
        self, spark: SparkSession, root: str, keys: Sequence[str] = (), merge: Callable[[DataFrame], DataFrame] | None = None, fan_in: int = FAN_IN, kind: str = "parquet"
    ):
        self.spark, self.root, self.keys, self.merge, self.fan_in, self.kind = spark, root.rstrip("/"), list(keys), merge, fan_in, kind

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def entries(self) -> list[Entry]:
        """All committed entries, covered ones too."""
        path, fs = self._path("entries")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        found = [m for m in map(_NAME.fullmatch, names) if m]
        return sorted((Entry(int(m[1]), int(m[2]), int(m[3]), m[4]) for m in found), key=lambda e: (e.first, -e.last, e.folder))

    def live(self) -> list[Entry]:
        """The entries that readers take: those that none before them covers."""
        out = []
        for e in self.entries():
            if not out or e.first > out[-1].last:
                out.append(e)
        return out

    def folders(self, entries: Sequence[Entry] | None = None) -> list[str]:
        return [f"{self.root}/data/part={e.folder}" for e in (self.live() if entries is None else entries)]

    def read(self, schema: T.StructType | str, entries: Sequence[Entry] | None = None) -> DataFrame:
        paths = self.folders(entries)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data").format(self.kind).load(paths).drop("part")

    def _commit(self, rows: DataFrame, first: int, last: int, level: int) -> None:
        entry = Entry(first, last, level, f"t{uuid.uuid4().hex}")
        kept = rows.hint("rebalance", *self.keys) if self.keys else rows.hint("rebalance")
        writer = kept.write.partitionBy(*self.keys) if self.keys else kept.write
        writer.format(self.kind).save(f"{self.root}/data/part={entry.folder}")
        path, fs = self._path(f"entries/{entry.name}")
        fs.create(path, False).close()

    def append(self, rows: DataFrame, batch: int) -> None:
        """Add the rows of a micro-batch; one that is already there, after a retry, is left as it is."""
        if not any(e.first <= batch <= e.last for e in self.entries()):
            self._commit(rows, batch, batch, 0)
        self.compact(rows.schema)

    def compact(self, schema: T.StructType | str) -> None:
        while True:
            tail = self.live()[-self.fan_in :]
            if len(tail) < self.fan_in or len({e.level for e in tail}) > 1:
                return
            self._sweep()
            rows = self.read(schema, tail)
            self._commit(self.merge(rows) if self.merge else rows, tail[0].first, tail[-1].last, tail[0].level + 1)

    def _sweep(self) -> None:
        """Delete what an earlier merge has covered, and folders that no entry names."""
        live = {e.folder for e in self.live()}
        for e in self.entries():
            if e.folder not in live:
                path, fs = self._path(f"entries/{e.name}")
                fs.delete(path, False)
        path, fs = self._path("data")
        for status in fs.listStatus(path):
            if status.getPath().getName().removeprefix("part=") not in live:
                fs.delete(status.getPath(), True)


def newest(rows: DataFrame, keys: Sequence[str], version: str = "batch") -> DataFrame:
    """The row of the latest version of each key."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_row"))
    return last.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
