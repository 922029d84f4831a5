"""Keyed state with event-time timers for the streams that depend on order: ST-3 and ST-5.

Rows are held in their key's state until the watermark (latest event time seen minus the allowed
delay) has passed them; an event-time timer then hands them on in (time, id) order. A row that
arrives at or below the watermark is late: it comes out at once, marked 'late', and changes nothing.
Spark keeps the state (RocksDB) and the watermark in the stream's checkpoint, so a stream that is
started again, after new rows or none, goes on where it stopped. Watermarks have milliseconds.

ST-3 has about as many keys as rows, so its state is not per key but per hash bucket of keys: a call into the state, a
frame and a timer serve all keys of a bucket, whose rows are kept as arrays.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from lingua_spark.session import list_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Stands for a row without a time: such rows are late.
NO_TIME = -(1 << 62)


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Stateful processors need the RocksDB provider; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def with_watermark(stream: DataFrame, t_us: str, delay_us: int) -> DataFrame:
    """The stream with a watermark on its time (micros). The marked column does not reach the operator, which
    sees late rows instead of having them dropped."""
    timed = stream.withColumn(t_us, F.coalesce(F.col(t_us), F.lit(NO_TIME)))
    seen = F.when(F.col(t_us) != NO_TIME, F.timestamp_micros(t_us))
    return timed.withColumn("_event_time", seen).withWatermark("_event_time", f"{delay_us // 1000} milliseconds").drop("_event_time")


class InOrder(StatefulProcessor):
    """Holds a key's rows (columns `held`, the first two being t_us and the id) until the watermark passes `due`."""
    held: list[str]
    held_type: str

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("held", self.held_type)

    def due(self, key, t_us: int) -> int:
        """Milliseconds at which a row of time t_us may go on."""
        return max(-(-t_us // 1000), 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        upto = mark * 1000 if mark > 0 else NO_TIME
        first = None
        for df in rows:
            late = df[self.held[0]] <= upto
            if late.any():
                yield self.late(key, df[late])
                df = df[~late]
            if len(df):
                self.rows.appendList(list(zip(*(df[c].tolist() for c in self.held), strict=True)))
                least = int(df[self.held[0]].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self.wake(self.due(key, first))

    def wake(self, at: int) -> None:
        """One timer per key, at the earliest time asked for."""
        for old in [*self.handle.listTimers()]:
            if old <= at:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        ready, wait = [], []
        for row in self.rows.get():
            (ready if self.due(key, row[0]) <= mark else wait).append(tuple(row))
        if wait:
            self.rows.put(wait)
            self.wake(min(self.due(key, r[0]) for r in wait))
        else:
            self.rows.clear()
        if ready:
            yield self.emit(key, sorted(ready, key=lambda r: r[:2]))

    def late(self, key, df: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def emit(self, key, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


#: Hash buckets of ST-3's keys, and the rows of one state entry.
BUCKETS, ENTRY_ROWS = 1024, 10_000


class WritesByTtl(InOrder):
    """ST-3: 'write' when no write of the key happened within the ttl before, else 'hit'. Its state is per bucket of keys:
    entries of held rows, and the keys' last writes as far as they can still make a hit."""
    held_type = "key array<string>, t_us array<long>, id array<long>"
    output = "key string, id long, t_us long, action string"

    def __init__(self, ttl_us: int) -> None:
        self.ttl_us = ttl_us

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "key array<string>, t_us array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        upto = mark * 1000 if mark > 0 else NO_TIME
        first = None
        for df in rows:
            late = df["t_us"] <= upto
            if late.any():
                yield df.loc[late, ["key", "id", "t_us"]].assign(action="late")
                df = df[~late]
            if len(df):
                self.rows.appendList(_entries(df))
                least = int(df["t_us"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self.wake(self.due(key, first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        held = pd.concat([pd.DataFrame({"key": pd.Series(list(k), dtype=object), "t_us": np.array(t, np.int64), "id": np.array(i, np.int64)}) for k, t, i in self.rows.get()])
        ready = np.maximum(-(-held["t_us"] // 1000), 1) <= mark
        wait = held[~ready]
        if len(wait):
            self.rows.put(_entries(wait))
            self.wake(self.due(key, int(wait["t_us"].min())))
        else:
            self.rows.clear()
        if ready.any():
            yield self.emit(key, held[ready].sort_values(["t_us", "id"]), mark * 1000)

    def emit(self, key, rows: pd.DataFrame, upto: int) -> pd.DataFrame:
        last = dict(zip(*self.last.get(), strict=True)) if self.last.exists() else {}
        actions = []
        for k, t in zip(_keys(rows), rows["t_us"].tolist(), strict=True):
            before = last.get(k)
            write = before is None or t > before + self.ttl_us
            if write:
                last[k] = t
            actions.append("write" if write else "hit")
        # rows to come are later than the watermark: a write that is past its ttl by then changes nothing
        near = {k: t for k, t in last.items() if t + self.ttl_us > upto}
        self.last.update((list(near), list(near.values())))
        return rows[["key", "id", "t_us"]].assign(action=actions)


def _keys(df: pd.DataFrame) -> list:
    """The rows' keys; null is a key of its own, whatever pandas reads it as."""
    return [k if isinstance(k, str) else None for k in df["key"]]


def _entries(df: pd.DataFrame) -> list[tuple]:
    """Rows as entries of arrays, ENTRY_ROWS at most in each."""
    columns = [_keys(df), df["t_us"].tolist(), df["id"].tolist()]
    return [tuple(c[i:i + ENTRY_ROWS] for c in columns) for i in range(0, len(df), ENTRY_ROWS)]


class RunsPerSlice(InOrder):
    """ST-5: failure runs inside one time slice of a provider, given on when the watermark has passed the slice.
    `run` counts the slice's own failures since its last success; `head` marks rows before its first one."""
    held, held_type = ["t_us", "call_id", "ok"], "t_us long, call_id long, ok boolean"
    output = "provider string, slice long, t_us long, call_id long, ok boolean, run long, head boolean, late boolean"

    def __init__(self, slice_us: int) -> None:
        self.slice_us = slice_us

    def due(self, key, t_us: int) -> int:
        return super().due(key, (int(key[1]) + 1) * self.slice_us)

    def late(self, key, df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"provider": key[0], "slice": key[1], "t_us": df["t_us"], "call_id": df["call_id"], "ok": df["ok"], "run": 0, "head": False, "late": True})

    def emit(self, key, rows: list[tuple]) -> pd.DataFrame:
        run, head, runs, heads = 0, True, [], []
        for _, _, ok in rows:
            run, head = (0, False) if ok else (run + 1, head)
            runs.append(run)
            heads.append(head)
        t, ids, ok = zip(*rows, strict=True)
        return pd.DataFrame({"provider": key[0], "slice": key[1], "t_us": t, "call_id": ids, "ok": ok, "run": runs, "head": heads, "late": False})


def started(spark: SparkSession, base: str) -> bool:
    """Whether the stream has finished a batch."""
    return any(not n.startswith(".") for n in list_dir(spark, os.path.join(base, "ckpt", "commits")))


def state(spark: SparkSession, base: str, variable: str) -> DataFrame:
    """The rows of a state variable as the stream left it."""
    return spark.read.format("statestore").option("path", os.path.join(base, "ckpt")).option("stateVarName", variable).load()
