"""The answer cache of a stream, as a log of runs: every batch adds the rows it changed, older rows stay where they are.

A run is a table with one row per key, bucketed and sorted by key_hash (see write_bucketed). Its folder names the
batches it covers, `run=<first>_<last>`; the first table is batch -1. FAN runs of one width are merged into one of
the next width, and after LEVELS widths into the first table, so there are at most FAN * LEVELS + 1 runs, and a row is
written again once per width. A lookup joins each run on key_hash, newest first, without shuffling it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lingua_spark.operators.cache import drop_bucketed, latest_by_key, open_bucketed, write_bucketed
from lingua_spark.session import list_dir

KEY = "key_hash"
FAN, LEVELS = 4, 3


class CacheLog:
    def __init__(self, spark: SparkSession, folder: str, initial: DataFrame, buckets: int | None = None):
        """`initial` is the cache before the first batch; the newest row of a key counts. `buckets` is fixed by
        whoever starts the log (default: spark.sql.shuffle.partitions)."""
        self.spark = spark
        found = [n for n in list_dir(spark, folder) if n.startswith("buckets=")]
        self.buckets = int(found[0].split("=")[1]) if found else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = os.path.join(folder, f"buckets={self.buckets}")
        # nullable throughout, as tables are
        self.schema = StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in initial.schema.fields))
        if (-1, -1) not in self._finished():
            self._write(self._newest(initial), -1, -1)

    def _newest(self, rows: DataFrame) -> DataFrame:
        return latest_by_key(rows.select(*self.schema.names), KEY, ["created_at"]).select(*self.schema.names)

    def _path(self, first: int, last: int) -> str:
        return os.path.join(self.folder, f"run={first}_{last}")

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        write_bucketed(rows, self._path(first, last), self.buckets, KEY)

    def _finished(self) -> list[tuple[int, int]]:
        names = [n for n in list_dir(self.spark, self.folder) if n.startswith("run=")]
        runs = [tuple(map(int, n[4:].split("_"))) for n in names]
        return sorted(r for r in runs if "_SUCCESS" in list_dir(self.spark, self._path(*r)))

    def cover(self, batch: int | None = None) -> list[tuple[int, int]]:
        """The runs that hold the cache as it was before a batch (None: now), newest first, the widest where there are several."""
        left = [r for r in self._finished() if batch is None or r[1] < batch]
        out = []
        while left:
            last = max(r[1] for r in left)
            first = min(r[0] for r in left if r[1] == last)
            out.append((first, last))
            left = [r for r in left if r[1] < first]
        return out

    def _open(self, run: tuple[int, int]) -> DataFrame:
        return open_bucketed(self.spark, self._path(*run), self.schema, self.buckets, KEY)

    def runs(self, batch: int | None = None) -> list[DataFrame]:
        return [self._open(r) for r in self.cover(batch)]

    def table(self, batch: int | None = None) -> DataFrame:
        """The cache as one table: the newest run's row of each key. Bucketed runs meet in anti joins without a shuffle."""
        return self._union(self.runs(batch))

    def _union(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for i, run in enumerate(runs[1:], 1):
            for newer in runs[:i]:
                run = run.join(newer.select(KEY), KEY, "left_anti")
            out = out.unionByName(run.select(*self.schema.names))
        return out

    def write(self, rows: DataFrame, batch: int) -> None:
        """The rows that a batch changed. Deleted first: what an interrupted run of the same batch left, and runs inside a
        wider one of earlier batches, which no batch from this one on reads."""
        done = self._finished()
        for a, b in done:
            if b >= batch or any(x <= a and b <= y < batch and (x, y) != (a, b) for x, y in done):
                drop_bucketed(self.spark, self._path(a, b))
        self._write(self._newest(rows), batch, batch)
        for level in range(1, LEVELS + 1):
            width = FAN**level
            if (batch + 1) % width:
                break
            first = -1 if level == LEVELS else batch + 1 - width
            self._write(self._union([self._open(r) for r in self.cover(batch + 1) if r[1] >= first]), first, batch)
