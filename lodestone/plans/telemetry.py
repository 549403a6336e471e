"""Telemetry program: A13-A23, K2-K3, O10, P17, W6-W7 over the event log."""

from __future__ import annotations

from lodestone.operators import telemetry as T
from lodestone.plans.adapters import METRICS, metric_events

_W = f"WITH {METRICS} "
_N = "count(*)"
_Q = lambda c, q, n: f"CAST(trunc(round(coalesce(quantile_cont({c}, {q}), 0), 6)) AS BIGINT) AS {n}"
_PCT = lambda n: f"round(coalesce(100.0 * {n} / nullif(count(*), 0), 0), 4)"
_C = "('analyze_directory', 'analyze_file', 'analyze_module', 'analyze_symbol')"
_BOUNDS = " ".join(f"WHEN duration_ms / 1000.0 <= {b} THEN {i}" for i, b in enumerate(T.BOUNDARIES))
_CACHE = f"""c AS (SELECT tool, count(*) AS cacheable, count_if(cache_hit) AS hits, nullif(quantile_cont(duration_ms, 0.5) FILTER (cache_hit), 0) AS h,
 nullif(quantile_cont(duration_ms, 0.5) FILTER (NOT cache_hit), 0) AS s, CAST(coalesce(sum(output_chars) FILTER (cache_hit), 0) AS BIGINT) AS hit_chars,
 count_if(cache_write_failure) AS write_failures FROM m WHERE tool IN {_C} GROUP BY tool),
c2 AS (SELECT tool, cacheable, hits, cacheable - hits AS misses, round(100.0 * hits / cacheable, 4) AS hit_rate, CAST(trunc(h) AS BIGINT) AS hit_dur_median,
 CAST(trunc(s) AS BIGINT) AS miss_dur_median, CAST(trunc(coalesce(s - h, 0)) AS BIGINT) AS ms_saved_per_hit, CAST(trunc(coalesce(s - h, 0) * hits) AS BIGINT) AS total_ms_saved, hit_chars, write_failures FROM c)"""


def _on(f, **options):
    return lambda spark, sf_dir: f(T.current(metric_events(spark, sf_dir)), **options)


QUERIES = {
    "a13_latency_by_tool": _on(T.latency),
    "a14_duration_histogram": _on(T.duration_histogram),
    "a15_reliability": _on(T.reliability),
    "a16_cache": _on(T.cache),
    "a16_cache_tiers": _on(T.cache_tiers),
    "a16_cache_totals": _on(T.cache_totals),
    "a17_trend": _on(T.trend),
    "a18_params_usage": _on(T.params_usage),
    "a19_pagination": _on(T.pagination),
    "a20_features": _on(T.features),
    "a20_match_modes": _on(T.match_modes),
    "a21_git_ref": _on(T.git_ref),
    "a22_timeouts": _on(T.timeouts),
    "a23_k2_session_summary": _on(T.session_summary),
    "o10_slowest_calls": _on(T.outliers),
    "p17_tool_and_days": lambda spark, d: T.current(metric_events(spark, d), tool="exec_command", start="2024-01-05", end="2024-01-10").groupBy("tool", "session_id").count(),
    "w6_sequence": lambda spark, d: T.sequence(metric_events(spark, d).drop("seq")).select("ord", "session_id", "seq"),
    "w7_breaker": _on(T.breaker, limit=2),
}

ORACLES = {
    "a13_latency_by_tool": _W + f"SELECT tool, {_N} AS calls, {_Q('duration_ms', .5, 'dur_p50')}, {_Q('duration_ms', .95, 'dur_p95')}, {_Q('duration_ms', .99, 'dur_p99')}, max(duration_ms) AS dur_max, {_Q('output_chars', .5, 'chars_p50')}, {_Q('output_chars', .95, 'chars_p95')}, max(output_chars) AS chars_max, {_PCT('count_if(output_truncated)')} AS truncated_pct FROM m GROUP BY tool",
    "a14_duration_histogram": _W + f", h AS (SELECT tool, CAST(CASE {_BOUNDS} ELSE {len(T.BOUNDARIES)} END AS INTEGER) AS bucket, count(*) AS n FROM m WHERE result <> 'received' GROUP BY 1, 2) SELECT tool, bucket, n, CAST(sum(n) OVER (PARTITION BY tool ORDER BY bucket) AS BIGINT) AS upto FROM h",
    "a15_reliability": _W + f""", k AS (SELECT tool, coalesce(error_type, 'unknown') AS t, count(*) AS c FROM m WHERE result = 'error' GROUP BY 1, 2), ks AS (SELECT tool, string_agg(t || '=' || c, ',' ORDER BY c DESC, t) AS error_types FROM k GROUP BY tool),
 b AS (SELECT tool, count(*) AS calls, {_PCT("count_if(result <> 'error')")} AS success_rate, {_PCT("count_if(result = 'error')")} AS error_rate, count_if(result = 'error') AS errors, count_if(coalesce(exit_code, 0) <> 0) AS exit_nonzero,
 {_PCT('count_if(coalesce(exit_code, 0) <> 0)')} AS exit_nonzero_pct, count_if(timed_out) AS timed_out, {_PCT('count_if(timed_out)')} AS timed_out_pct FROM m GROUP BY tool) SELECT b.*, coalesce(error_types, '') AS error_types FROM b LEFT JOIN ks USING (tool)""",
    "a16_cache": _W + f", {_CACHE} SELECT * FROM c2",
    "a16_cache_tiers": _W + f"SELECT coalesce(cache_tier, 'unknown') AS tier, count(*) AS hits FROM m WHERE tool IN {_C} AND cache_hit GROUP BY 1",
    "a16_cache_totals": _W + f", {_CACHE} SELECT CAST(sum(hits) AS BIGINT) AS total_hits, CAST(sum(misses) AS BIGINT) AS total_misses, CAST(sum(total_ms_saved) AS BIGINT) AS total_ms_saved, CAST(sum(write_failures) AS BIGINT) AS write_failures, round(100.0 * sum(write_failures) / sum(cacheable), 4) AS write_failure_rate, round(100.0 * sum(hits) / sum(cacheable), 4) AS overall_hit_rate, CAST(sum(cacheable) AS BIGINT) AS total_cacheable, CAST(sum(hit_chars) AS BIGINT) AS total_hit_chars FROM c2",
    "a17_trend": _W + f"""SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day, {_N} AS calls, {_PCT("count_if(result <> 'error')")} AS success_rate, {_PCT("count_if(result = 'error')")} AS error_rate, CASE WHEN count_if(cache_hit) > 0 THEN {_PCT('count_if(cache_hit)')} END AS cache_hit_rate,
 {_PCT('count_if(coalesce(exit_code, 0) <> 0)')} AS exec_nonzero_pct, {_Q('duration_ms', .95, 'dur_p95')}, {_Q('duration_ms', .99, 'dur_p99')}, {_Q('output_chars', .95, 'chars_p95')} FROM m GROUP BY 1""",
    "a18_params_usage": _W + ", f AS (" + " UNION ALL ".join(f"SELECT tool, '{p}' AS field, {p} AS value FROM m" for p in T.PARAMS) + ") SELECT tool, field, count_if(value) AS true_count, count(value) AS present FROM f WHERE value IS NOT NULL GROUP BY tool, field",
    "a19_pagination": _W + "SELECT count_if(is_paginated) AS paginated, count_if(coalesce(is_paginated, false) = false AND summary_mode) AS summary_mode, count_if(NOT coalesce(is_paginated, false) AND NOT coalesce(summary_mode, false)) AS first_page_only, count(*) AS total FROM m HAVING bool_or(is_paginated IS NOT NULL OR summary_mode IS NOT NULL)",
    "a20_features": _W + ", f AS (" + " UNION ALL ".join(f"SELECT '{p}' AS field, {p} AS value FROM m WHERE tool = 'analyze_symbol'" for p in T.FEATURES) + ") SELECT field, count_if(value) AS true_count, count_if(NOT value) AS false_count FROM f GROUP BY field",
    "a20_match_modes": _W + "SELECT coalesce(match_mode, 'exact') AS match_mode, count(*) AS n FROM m WHERE tool = 'analyze_symbol' GROUP BY 1",
    "a21_git_ref": _W + "SELECT tool, count(*) AS calls, count_if(git_ref_used) AS git_ref_used FROM m WHERE tool IN ('analyze_directory', 'analyze_symbol') GROUP BY tool",
    "a22_timeouts": _W + ", t AS (SELECT CASE WHEN timeout_configured_ms IS NULL THEN 0 WHEN timeout_configured_ms < 1000 THEN 1 WHEN timeout_configured_ms <= 10000 THEN 2 WHEN timeout_configured_ms <= 60000 THEN 3 ELSE 4 END AS ord, drain_timeout_ms FROM m WHERE tool = 'exec_command'), b(ord, bucket) AS (VALUES (0, 'none'), (1, '<1000'), (2, '1000-10000'), (3, '10000-60000'), (4, '>60000')) SELECT CAST(b.ord AS INTEGER) AS ord, bucket, count(t.ord) AS n, count(drain_timeout_ms) AS drain_configured FROM b LEFT JOIN t ON b.ord = t.ord GROUP BY 1, 2",
    "a23_k2_session_summary": _W + "SELECT tool, count(*) AS call_count, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms, CAST(sum(output_chars) AS BIGINT) AS total_output_chars, arg_min(session_id, ord) AS first_session_id FROM m GROUP BY tool",
    "o10_slowest_calls": _W + "SELECT duration_ms, tool, session_id, CAST(seq AS INTEGER) AS seq, timed_out, exit_code FROM m ORDER BY duration_ms DESC, ord LIMIT 10",
    "p17_tool_and_days": _W + "SELECT tool, session_id, count(*) AS count FROM m WHERE tool = 'exec_command' AND CAST(make_timestamp(ts * 1000) AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-10' GROUP BY tool, session_id",
    "w6_sequence": _W + "SELECT ord, session_id, CAST(seq AS INTEGER) AS seq FROM m",
    "w7_breaker": _W + ", r AS (SELECT *, sum(CASE WHEN result = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, tool ORDER BY ts, ord ROWS UNBOUNDED PRECEDING) AS island FROM m), q AS (SELECT *, row_number() OVER (PARTITION BY session_id, tool, island ORDER BY ts, ord) AS streak FROM r WHERE result = 'error') SELECT ord, session_id, tool, CAST(streak AS INTEGER) AS streak, streak >= 2 AS tripped FROM q",
}
