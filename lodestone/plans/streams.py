"""Streaming program: the event table read as a stream until it is used up, into folders beside the checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.adapters import METRICS, metric_events
from lodestone.session import shared_folder, table
from lodestone.streaming import metrics as S
from lodestone.streaming import stateful


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return metric_events(spark, sf_dir, raw)


def _drained(df: DataFrame, mode: str) -> DataFrame:
    """What the stream gives in all: appended files, or in mode complete the last batch."""
    top = f"{shared_folder(df.sparkSession)}/drained-{uuid.uuid4().hex}"
    start = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{top}/state")
    if mode == "complete":
        start = start.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{top}/rows"))
    else:
        start = start.format("parquet").option("path", f"{top}/rows")
    start.start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{top}/rows")


def _trend(spark, sf_dir):
    return _drained(S.daily_trend(_stream(spark, sf_dir)), "complete").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "tool", "calls", "errors")


_DAY = 86_400_000
_EXIT, _DRAIN = 788_918_400_000, 30 * _DAY  # 1995-01-01


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each supplier: its line items are lines at their ship date, in two streams; it ends in one of five years, every sixth never. The last row is later than all."""
    top = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    at = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("run_id"), F.when(F.col("l_linenumber") % 3 == 0, "stderr").otherwise("stdout").alias("source"), at.alias("at"))
    k = F.col("s_suppkey").cast("long")
    ends = table(spark, sf_dir, "supplier").filter("s_suppkey % 6 <> 0").select(k.alias("run_id"), F.lit("exit").alias("source"), (F.lit(_EXIT) + k % 5 * (365 * _DAY)).alias("at"))
    lines.unionByName(ends).write.parquet(top)
    spark.sql("SELECT -1L AS run_id, 'stdout' AS source, 4102444800000L AS at").write.mode("append").parquet(top)
    return spark.readStream.schema("run_id long, source string, at long").parquet(top)


QUERIES = {
    "r5_streaks_in_store": lambda s, d: _drained(stateful.failure_streaks(_stream(s, d), 2, ord="ord"), "append").select("session_id", "tool", "ord", "streak", "tripped"),
    "r6_r7_late_lines": lambda s, d: _drained(stateful.drained(_lines(s, d), _DRAIN, delay="4000 days"), "append"),
    "r1_r4_running_totals": lambda s, d: _drained(S.running_totals(_stream(s, d)), "complete"),
    "r5_breaker_state": lambda s, d: _drained(S.breaker(_stream(s, d), 2, ord="ord"), "append").select("session_id", "tool", "ord", "streak", "tripped"),
    "r6_merged": lambda s, d: _drained(S.merged(_stream(s, d).filter("result = 'ok'"), _stream(s, d).filter("result <> 'ok'")).select("ord", "tool"), "append"),
    "r7_r8_daily_trend": _trend,
}

_W = f"WITH {METRICS} "

_BREAKER = ", r AS (SELECT *, sum(CASE WHEN result = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, tool ORDER BY ts, ord ROWS UNBOUNDED PRECEDING) AS island FROM m), q AS (SELECT *, row_number() OVER (PARTITION BY session_id, tool, island ORDER BY ts, ord) AS streak FROM r WHERE result = 'error') SELECT session_id, tool, ord, CAST(streak AS INTEGER) AS streak, streak >= 2 AS tripped FROM q"

ORACLES = {
    "r5_streaks_in_store": _W + _BREAKER,
    "r6_r7_late_lines": f"SELECT CAST(s_suppkey AS BIGINT) AS run_id, count_if(NOT late AND NOT err) AS kept_stdout, count_if(NOT late AND err) AS kept_stderr, count_if(late AND NOT err) AS late_stdout, count_if(late AND err) AS late_stderr, count_if(late) > 0 AS output_truncated FROM (SELECT s_suppkey, l_linenumber % 3 = 0 AS err, epoch_ms(CAST(l_shipdate AS TIMESTAMP)) > {_EXIT} + s_suppkey % 5 * {365 * _DAY} + {_DRAIN} AS late FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey WHERE s_suppkey % 6 <> 0) GROUP BY s_suppkey",
    "r1_r4_running_totals": _W + "SELECT tool, count(*) AS call_count, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms, CAST(sum(output_chars) AS BIGINT) AS total_output_chars FROM m GROUP BY tool",
    "r5_breaker_state": _W + _BREAKER,
    "r6_merged": _W + "SELECT ord, tool FROM m",
    "r7_r8_daily_trend": _W + "SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day, tool, count(*) AS calls, count_if(result = 'error') AS errors FROM m GROUP BY 1, 2",
}
