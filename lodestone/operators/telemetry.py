"""Reports over the telemetry log: one aggregation each, all from one scan of ``metric_events``."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import pct, quantile, whole

CACHEABLE = ("analyze_directory", "analyze_file", "analyze_module", "analyze_symbol")
CURRENT = (*CACHEABLE, "edit_overwrite", "edit_replace", "exec_command")
#: Upper bounds, in seconds, of the duration histogram.
BOUNDARIES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)


def count_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def current(m: DataFrame, tool: str | None = None, start: str | None = None, end: str | None = None, all_tools: bool = False, include_received: bool = True) -> DataFrame:
    """Rows of the tools in use, of one tool and of days from ``start`` to ``end``."""
    if not all_tools:
        m = m.filter(F.col("tool").isin(*CURRENT))
    if tool:
        m = m.filter(F.col("tool") == tool)
    # Bounds in milliseconds, so that a scan prunes by them.
    ms = lambda day, more=0: (date.fromisoformat(day).toordinal() + more - date(1970, 1, 1).toordinal()) * 86_400_000
    if start:
        m = m.filter(F.col("ts") >= ms(start))
    if end:
        m = m.filter(F.col("ts") < ms(end, 1))
    return m if include_received else m.filter(~F.col("result").eqNullSafe(F.lit("received")))


def latency(m: DataFrame) -> DataFrame:
    """A13."""
    q = lambda c, x, name: whole(quantile(F.col(c), x)).alias(name)
    return m.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"), q("duration_ms", 0.5, "dur_p50"), q("duration_ms", 0.95, "dur_p95"), q("duration_ms", 0.99, "dur_p99"), F.max("duration_ms").alias("dur_max"),
        q("output_chars", 0.5, "chars_p50"), q("output_chars", 0.95, "chars_p95"), F.max("output_chars").alias("chars_max"), F.round(pct(count_if(F.col("output_truncated")), F.count(F.lit(1))), 4).alias("truncated_pct"),
    )


def duration_histogram(m: DataFrame) -> DataFrame:
    """Calls in each bucket up to its bound in seconds, and so far; ``received`` events don't count."""
    m = m.filter(~F.col("result").eqNullSafe(F.lit("received")))
    s = F.col("duration_ms") / 1000.0
    bucket = F.coalesce(*[F.when(s <= b, F.lit(i)) for i, b in enumerate(BOUNDARIES)], F.lit(len(BOUNDARIES)))
    counts = m.groupBy("tool", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("upto", F.sum("n").over(Window.partitionBy("tool").orderBy("bucket")))


def reliability(m: DataFrame) -> DataFrame:
    """A15."""
    n, bad, nonzero, late = F.count(F.lit(1)), count_if(F.col("result") == "error"), count_if(F.coalesce("exit_code", F.lit(0)) != 0), count_if(F.col("timed_out"))
    kinds = m.filter("result = 'error'").groupBy("tool", F.coalesce("error_type", F.lit("unknown")).alias("t")).agg(F.count(F.lit(1)).alias("c"))
    kinds = kinds.groupBy("tool").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), F.col("t")))), lambda x: F.concat_ws("=", x["t"], (-x["c"]).cast("string"))), ",").alias("error_types"))
    base = m.groupBy("tool").agg(
        n.alias("calls"), F.round(pct(n - bad, n), 4).alias("success_rate"), F.round(pct(bad, n), 4).alias("error_rate"), bad.alias("errors"),
        nonzero.alias("exit_nonzero"), F.round(pct(nonzero, n), 4).alias("exit_nonzero_pct"), late.alias("timed_out"), F.round(pct(late, n), 4).alias("timed_out_pct"),
    )
    return base.join(kinds, "tool", "left").withColumn("error_types", F.coalesce("error_types", F.lit("")))


def cache(m: DataFrame) -> DataFrame:
    """Hits against misses of each cacheable tool. A median of 0 counts as none, and saves nothing."""
    m = m.filter(F.col("tool").isin(*CACHEABLE))
    hit, dur = F.col("cache_hit"), F.col("duration_ms")
    base = m.groupBy("tool").agg(
        F.count(F.lit(1)).alias("cacheable"), count_if(hit).alias("hits"), F.nullif(F.median(F.when(hit, dur)), F.lit(0.0)).alias("h"), F.nullif(F.median(F.when(~hit, dur)), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(F.when(hit, F.col("output_chars"))), F.lit(0)).alias("hit_chars"), count_if(F.col("cache_write_failure")).alias("write_failures"),
    )
    saved = F.coalesce(F.col("s") - F.col("h"), F.lit(0.0))
    return base.select("tool", "cacheable", "hits", (F.col("cacheable") - F.col("hits")).alias("misses"), F.round(pct(F.col("hits"), F.col("cacheable")), 4).alias("hit_rate"), whole(F.col("h")).alias("hit_dur_median"), whole(F.col("s")).alias("miss_dur_median"), whole(saved).alias("ms_saved_per_hit"), whole(saved * F.col("hits")).alias("total_ms_saved"), "hit_chars", "write_failures")


def cache_tiers(m: DataFrame) -> DataFrame:
    """Hits in each tier."""
    return m.filter(F.col("tool").isin(*CACHEABLE) & F.col("cache_hit")).groupBy(F.coalesce("cache_tier", F.lit("unknown")).alias("tier")).agg(F.count(F.lit(1)).alias("hits"))


def cache_totals(m: DataFrame) -> DataFrame:
    """Over all cacheable tools."""
    c = cache(m)
    return c.agg(F.sum("hits").alias("total_hits"), F.sum("misses").alias("total_misses"), F.sum("total_ms_saved").alias("total_ms_saved"), F.sum("write_failures").alias("write_failures"), F.round(pct(F.sum("write_failures"), F.sum("cacheable")), 4).alias("write_failure_rate"), F.round(pct(F.sum("hits"), F.sum("cacheable")), 4).alias("overall_hit_rate"), F.sum("cacheable").alias("total_cacheable"), F.sum("hit_chars").alias("total_hit_chars"))


def trend(m: DataFrame) -> DataFrame:
    """One row for each UTC day; no hit rate on days without hits."""
    n, bad, hits, nonzero = F.count(F.lit(1)), count_if(F.col("result") == "error"), count_if(F.col("cache_hit")), count_if(F.coalesce("exit_code", F.lit(0)) != 0)
    q = lambda c, x, name: whole(quantile(F.col(c), x)).alias(name)
    return m.groupBy(F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd").alias("day")).agg(
        n.alias("calls"), F.round(pct(n - bad, n), 4).alias("success_rate"), F.round(pct(bad, n), 4).alias("error_rate"), F.when(hits > 0, F.round(pct(hits, n), 4)).alias("cache_hit_rate"),
        F.round(pct(nonzero, n), 4).alias("exec_nonzero_pct"), q("duration_ms", 0.95, "dur_p95"), q("duration_ms", 0.99, "dur_p99"), q("output_chars", 0.95, "chars_p95"),
    )


PARAMS = ("summary_mode", "fields_projected", "working_dir_used", "stdin_provided")


def params_usage(m: DataFrame) -> DataFrame:
    """How often each flag is set and is true; unset isn't false."""
    flat = m.select("tool", *PARAMS).unpivot("tool", list(PARAMS), "field", "value").filter("value is not null")
    return flat.groupBy("tool", "field").agg(count_if(F.col("value")).alias("true_count"), F.count("value").alias("present"))


def pagination(m: DataFrame) -> DataFrame:
    """Paginated, else summary, else first page; no row when no record has either field."""
    known = m.agg(F.bool_or(F.col("is_paginated").isNotNull() | F.col("summary_mode").isNotNull()).alias("any"))
    page, summary = F.coalesce("is_paginated", F.lit(False)), F.coalesce("summary_mode", F.lit(False))
    return m.agg(F.count_if(page).alias("paginated"), F.count_if(~page & summary).alias("summary_mode"), F.count_if(~page & ~summary).alias("first_page_only"), F.count(F.lit(1)).alias("total")).join(known, F.col("any")).drop("any")


FEATURES = ("import_lookup", "def_use", "impl_only")


def features(m: DataFrame, tool: str = "analyze_symbol") -> DataFrame:
    """True and false counts of the tool's flags."""
    flat = m.filter(F.col("tool") == tool).select(F.lit(1).alias("one"), *FEATURES).unpivot("one", list(FEATURES), "field", "value")
    return flat.groupBy("field").agg(count_if(F.col("value")).alias("true_count"), count_if(~F.col("value")).alias("false_count"))


def match_modes(m: DataFrame, tool: str = "analyze_symbol") -> DataFrame:
    """Match modes, ``exact`` if none is named."""
    return m.filter(F.col("tool") == tool).groupBy(F.coalesce(F.nullif("match_mode", F.lit("")), F.lit("exact")).alias("match_mode")).agg(F.count(F.lit(1)).alias("n"))


def git_ref(m: DataFrame) -> DataFrame:
    """A21."""
    return m.filter(F.col("tool").isin("analyze_directory", "analyze_symbol")).groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), count_if(F.col("git_ref_used")).alias("git_ref_used"))


BUCKETS = ("none", "<1000", "1000-10000", "10000-60000", ">60000")


def timeouts(m: DataFrame, tool: str = "exec_command") -> DataFrame:
    """Every bucket, empty ones with 0."""
    t = F.col("timeout_configured_ms")
    bucket = F.when(t.isNull(), BUCKETS[0]).when(t < 1000, BUCKETS[1]).when(t <= 10_000, BUCKETS[2]).when(t <= 60_000, BUCKETS[3]).otherwise(BUCKETS[4])
    counts = m.filter(F.col("tool") == tool).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count("drain_timeout_ms").alias("drain_configured"))
    dim = m.sparkSession.createDataFrame([(i, b) for i, b in enumerate(BUCKETS)], "ord int, bucket string")
    return dim.join(counts, "bucket", "left").select("ord", "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("drain_configured", F.lit(0)).alias("drain_configured"))


def outliers(m: DataFrame, n: int = 10) -> DataFrame:
    """The slowest calls, ties in log order."""
    return m.orderBy(F.desc("duration_ms"), "ord").limit(n).select("duration_ms", "tool", "session_id", "seq", F.coalesce("timed_out", F.lit(False)).alias("timed_out"), "exit_code")


def session_summary(m: DataFrame) -> DataFrame:
    """Totals of each tool, and the first session that was seen."""
    return m.groupBy("tool").agg(F.count(F.lit(1)).alias("call_count"), F.sum("duration_ms").alias("total_duration_ms"), F.sum("output_chars").alias("total_output_chars"), F.min_by("session_id", "ord").alias("first_session_id"))


def sequence(m: DataFrame) -> DataFrame:
    """Number of a call within its session, from 0."""
    return m.withColumn("seq", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "ord")) - 1)


def breaker(m: DataFrame, limit: int = 5) -> DataFrame:
    """Runs of failures within (session, tool); a success ends a run, the ``limit``-th failure trips."""
    w = Window.partitionBy("session_id", "tool").orderBy("ts", "ord")
    ok = F.when(F.col("result") == "error", 0).otherwise(1)
    runs = m.withColumn("island", F.sum(ok).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("result = 'error'")
    runs = runs.withColumn("streak", F.row_number().over(Window.partitionBy("session_id", "tool", "island").orderBy("ts", "ord")))
    return runs.select("ord", "session_id", "tool", "streak", (F.col("streak") >= limit).alias("tripped"))


SECTIONS = {"latency": latency, "reliability": reliability, "cache": cache, "outliers": outliers, "trend": trend, "params": params_usage, "pagination": pagination, "features": features, "git_ref": git_ref, "timeout": timeouts}


@contextmanager
def report(m: DataFrame, sections: list[str] | None = None) -> Iterator[dict[str, DataFrame]]:
    """The sections by name, from one scan that is persisted while they are read."""
    m = m.persist()
    try:
        yield {k: f(m) for k, f in SECTIONS.items() if sections is None or k in sections}
    finally:
        m.unpersist()
