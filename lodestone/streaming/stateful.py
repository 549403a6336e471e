"""Streams with state of their own: failure streaks (R5, W7), and lines that come after a command's end.

Both are processors of ``transformWithStateInPandas``; their state lies in RocksDB, which ``keep_state`` chooses for the session. Rows of a key come in chunks and
are never put together as one frame: of a streak's rows in one batch only numbers are kept to be ordered (the trigger bounds a batch), of a command's lines
only counts, or until its end is known their times in the store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STREAK = "session_id string, tool string, ts bigint, ord bigint, streak int, tripped boolean"
DRAINED = "run_id bigint, kept_stdout bigint, kept_stderr bigint, late_stdout bigint, late_stderr bigint, output_truncated boolean"
_CHUNK = 10_000


def keep_state(spark: SparkSession) -> None:
    """The store that these processors need, for streams that the session starts from now on; one that was chosen already stays."""
    if "RocksDB" not in (spark.conf.get(PROVIDER, None) or ""):
        spark.conf.set(PROVIDER, ROCKSDB)


def streaks(failed: np.ndarray, before: int) -> np.ndarray:
    """Failures in a row up to each place, ``before`` of them ahead of the first."""
    at = np.arange(1, len(failed) + 1)
    reset = np.maximum.accumulate(np.where(failed, 0, at))
    return np.where(failed, at - reset + np.where(reset == 0, before, 0), 0)


class _Streaks(StatefulProcessor):
    def __init__(self, limit: int, idle_ms: int | None) -> None:
        self.limit, self.idle_ms = limit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.running = handle.getValueState("running", "n int", self.idle_ms) if self.idle_ms else handle.getValueState("running", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [(f["ts"].to_numpy("int64"), f["ord"].to_numpy("int64"), f["failed"].to_numpy("bool")) for f in rows]
        ts, ord_, failed = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((ord_, ts))
        before = self.running.get()[0] if self.running.exists() else 0
        n = streaks(failed[order], before)
        if n[-1]:
            self.running.update((int(n[-1]),))
        elif before:
            self.running.clear()
        shown = np.flatnonzero(n)
        for b in range(0, len(shown), _CHUNK):
            at = shown[b : b + _CHUNK]
            yield pd.DataFrame({"session_id": key[0], "tool": key[1], "ts": ts[order][at], "ord": ord_[order][at], "streak": n[at].astype("int32"), "tripped": n[at] >= self.limit})

    def close(self) -> None:
        pass


def failure_streaks(stream: DataFrame, limit: int = 5, idle_ms: int | None = None, ord: str | None = None) -> DataFrame:
    """Failures in a row of each (session, tool) by time, and ``ord`` where times are equal; a success starts anew.

    State is one number for each running streak, none after a success. With ``idle_ms`` it also ends by its time to live, in processing time; a
    stream like that never runs out of batches. A row without a time counts as the earliest, one without a result as a success.
    """
    keep_state(stream.sparkSession)
    given = stream.select("session_id", "tool", F.coalesce("ts", F.lit(-(2**63))).alias("ts"), (F.coalesce(F.col(ord), F.lit(0)) if ord else F.lit(0)).cast("long").alias("ord"), F.coalesce(F.col("result") == "error", F.lit(False)).alias("failed"))
    return given.groupBy("session_id", "tool").transformWithStateInPandas(_Streaks(limit, idle_ms), STREAK, "append", "ProcessingTime" if idle_ms else "None")


class _Drain(StatefulProcessor):
    def __init__(self, drain_ms: int, hold_ms: int) -> None:
        self.drain_ms, self.hold_ms = drain_ms, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ended = handle.getValueState("ended", "at bigint")
        self.counts = handle.getValueState("counts", "kept_out bigint, kept_err bigint, late_out bigint, late_err bigint")
        self.open = handle.getListState("open", "at bigint, err boolean")

    def _count(self, n: np.ndarray, at: np.ndarray, err: np.ndarray, end: int) -> None:
        late = at > end + self.drain_ms
        for k, mask in enumerate((~late & ~err, ~late & err, late & ~err, late & err)):
            n[k] += int(mask.sum())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end = self.ended.get()[0] if self.ended.exists() else None
        known = end is not None
        n = np.array(self.counts.get() if self.counts.exists() else (0, 0, 0, 0), "int64")
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for f in rows:
            source, at = f["source"].to_numpy(), f["at"].to_numpy("int64")
            ends, lines = source == "exit", (source == "stdout") | (source == "stderr")
            if ends.any() and not known:
                first = int(at[ends].min())
                end = first if end is None else min(end, first)
            if lines.any():
                own = at[lines], source[lines] == "stderr"
                if known:
                    self._count(n, *own, end)
                elif end is None and sum(len(a) for a, _ in waiting) < _CHUNK:
                    waiting.append(own)
                else:  # an end seen in this batch may yet be an earlier one: the store holds what is not decided
                    waiting.append(own)
                    self._store(waiting)
                    waiting = []
        if end is None:
            self._store(waiting)
        else:
            if not known:
                self.ended.update((end,))
                self.handle.registerTimer(end + self.drain_ms + self.hold_ms)
                block: list[tuple] = []
                for row in self.open.get() if self.open.exists() else ():
                    block.append(row)
                    if len(block) == _CHUNK:
                        self._count(n, np.array([r[0] for r in block], "int64"), np.array([r[1] for r in block], "bool"), end)
                        block = []
                if block:
                    self._count(n, np.array([r[0] for r in block], "int64"), np.array([r[1] for r in block], "bool"), end)
                self.open.clear()
                for own in waiting:
                    self._count(n, *own, end)
            self.counts.update(tuple(int(v) for v in n))
        yield pd.DataFrame()

    def _store(self, waiting: list[tuple[np.ndarray, np.ndarray]]) -> None:
        for at, err in waiting:
            for b in range(0, len(at), _CHUNK):
                self.open.appendList([(int(a), bool(e)) for a, e in zip(at[b : b + _CHUNK], err[b : b + _CHUNK], strict=True)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.counts.get()
        self.ended.clear()
        self.counts.clear()
        yield pd.DataFrame({"run_id": [key[0]], "kept_stdout": [n[0]], "kept_stderr": [n[1]], "late_stdout": [n[2]], "late_stderr": [n[3]], "output_truncated": [n[2] + n[3] > 0]})

    def close(self) -> None:
        pass


def drained(lines: DataFrame, drain_ms: int = 500, hold_ms: int = 10_000, delay: str = "10 seconds") -> DataFrame:
    """What a command wrote in its two streams until ``drain_ms`` after its exit, and how many lines came later.

    ``lines`` has run_id, source (stdout, stderr or exit; others are skipped) and at (ms, event time; rows without it or a run are skipped). The exit that comes first, the earliest of its batch, sets a run's deadline; a line after it isn't
    kept but counted, and the run flagged as truncated. Lines may come in any order, also before the exit: until that is known their times wait in the store.
    A run's row is given once the watermark, ``delay`` behind the latest time, is ``hold_ms`` past the deadline; one without an exit gives none. Lines that come after the row is given are lost to the watermark.
    """
    keep_state(lines.sparkSession)
    given = lines.filter("run_id is not null and at is not null and source in ('stdout', 'stderr', 'exit')").select(F.col("run_id").cast("long").alias("run_id"), "source", F.col("at").cast("long").alias("at"), F.timestamp_millis("at").alias("time"))
    return given.withWatermark("time", delay).groupBy("run_id").transformWithStateInPandas(_Drain(drain_ms, hold_ms), DRAINED, "append", "EventTime")
