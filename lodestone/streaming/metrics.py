"""The telemetry log as a stream: micro-batches into daily folders, running totals, failure streaks, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.files import METRICS


def events(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """New files of the log, at most ``files`` a batch; lines that are broken are dropped."""
    return spark.readStream.schema(METRICS).option("maxFilesPerTrigger", files).json(folder).filter("ts is not null")


def merged(*streams: DataFrame) -> DataFrame:
    """Streams as one; the order is that of their time column."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def write_daily(stream: DataFrame, out: str, checkpoint: str, by_event_day: bool = False, batch: int = 100, **trigger):
    """JSON lines in folders by the day of the write, or of the event, at most ``batch`` events a file."""
    day = F.to_date(F.timestamp_millis("ts")) if by_event_day else F.current_date()
    return stream.withColumn("date", day).writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", batch).partitionBy("date").trigger(**(trigger or {"availableNow": True})).start()


def running_totals(stream: DataFrame) -> DataFrame:
    """Totals of each tool so far; for output mode complete."""
    return stream.groupBy("tool").agg(F.count(F.lit(1)).alias("call_count"), F.sum("duration_ms").alias("total_duration_ms"), F.sum("output_chars").alias("total_output_chars"))


def daily_trend(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """A17 as a stream: tumbling days. In output mode append, events later than ``late`` are dropped (R7); in mode complete none is."""
    t = stream.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    return t.groupBy(F.window("at", "1 day"), "tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("result") == "error").alias("errors")).select(F.col("window.start").alias("day"), "tool", "calls", "errors")


STREAK = "session_id string, tool string, ts bigint, ord bigint, streak int, tripped boolean"


def breaker(stream: DataFrame, limit: int = 5, idle_ms: int | None = None, ord: str | None = None) -> DataFrame:
    """Failures in a row of each (session, tool), kept as state; a success starts anew.

    Uses applyInPandasWithState; rows of a batch are taken in the order of their time, and of ``ord`` where times are equal.
    Only running streaks are state: a success removes it, and so does a pause of
    ``idle_ms`` of processing time, if given; such a query never runs out of batches, so it isn't for the trigger availableNow.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ts", "ord"], kind="stable")
        out = []
        for ts, at, result in zip(rows["ts"], rows["ord"], rows["result"], strict=True):
            n = n + 1 if result == "error" else 0
            if n:
                out.append((*key, int(ts), int(at), n, n >= limit))
        if n:
            state.update((n,))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["session_id", "tool", "ts", "ord", "streak", "tripped"])

    given = stream.select("session_id", "tool", "ts", (F.col(ord) if ord else F.lit(0)).cast("long").alias("ord"), "result")
    return given.groupBy("session_id", "tool").applyInPandasWithState(step, STREAK, "n int", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
