"""Session and benchmark program: orders as sessions and runs, conversations as transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import sessions as S
from lodestone.session import table

_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _sessions(s, d):
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    p = F.col("o_orderpriority")
    return o.select(
        F.when(k % 13 == 0, F.concat(F.lit("x-"), k.cast("string"))).otherwise(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), k.cast("string"))).alias("session_id"), (k % 5 == 0).alias("incomplete"),
        F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "FAIL").alias("verdict"), (k % 7 == 0).alias("retry"), F.when(k % 2 == 0, F.concat(F.lit("pr/"), k.cast("string"))).alias("pr_url"),
        F.when(F.startswith(p, F.lit("1")), "SIMPLE").when(F.startswith(p, F.lit("2")), "MEDIUM").when(F.startswith(p, F.lit("3")), "COMPLEX").alias("complexity"),
    )


_SESSIONS = """s AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'x-' || o_orderkey ELSE strftime(o_orderdate, '%Y%m%d') || '-' || o_orderkey END AS session_id, o_orderkey % 5 = 0 AS incomplete,
 CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'FAIL' END AS verdict, o_orderkey % 7 = 0 AS retry, CASE WHEN o_orderkey % 2 = 0 THEN 'pr/' || o_orderkey END AS pr_url,
 CASE left(o_orderpriority, 1) WHEN '1' THEN 'SIMPLE' WHEN '2' THEN 'MEDIUM' WHEN '3' THEN 'COMPLEX' END AS complexity FROM orders)"""


def _calls(s, d):
    """Each turn is a tool call; the tool and its input follow from the turn and the length of the text."""
    n = F.length("text")
    tool = F.element_at(F.array(*map(F.lit, ("Bash", "Read", "analyze_file", "analyze_symbol", "ext__shell", "Write"))), (n % 6 + 1).cast("int"))
    cmd = F.element_at(F.array(*map(F.lit, ("git status", "rg 'fn main'", "cat /tmp/out.json", "python run.py /tmp/x"))), (n % 4 + 1).cast("int"))
    return table(s, d, "conversations").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("idx"), tool.alias("tool"), cmd.alias("command"), F.when(n % 4 == 0, "/tmp/a").otherwise("src/a").alias("file"),
        F.when(F.col("conv_id") % 3 == 0, "A").when(F.col("conv_id") % 3 == 1, "A2").otherwise("B").alias("condition"), F.to_json(F.struct(F.when(n % 3 == 0, True).alias("summary"), F.when(n % 5 == 0, "c").alias("cursor"))).alias("input"),
    )


_CALLS = """c AS (SELECT conv_id AS session, turn AS idx, ['Bash', 'Read', 'analyze_file', 'analyze_symbol', 'ext__shell', 'Write'][length(text) % 6 + 1] AS tool,
 ['git status', 'rg ''fn main''', 'cat /tmp/out.json', 'python run.py /tmp/x'][length(text) % 4 + 1] AS command, CASE WHEN length(text) % 4 = 0 THEN '/tmp/a' ELSE 'src/a' END AS file,
 ['A', 'A2', 'B'][conv_id % 3 + 1] AS condition, length(text) AS n FROM conversations),
k AS (SELECT *, CASE WHEN tool IN ('analyze_file', 'analyze_symbol') THEN 'mcp' WHEN tool = 'Bash' AND split_part(command, ' ', 1) IN ('git', 'cat') THEN 'system' WHEN tool = 'Bash' AND contains(command, '/tmp/') THEN 'output'
 WHEN tool = 'Read' AND starts_with(file, '/tmp/') THEN 'output' WHEN tool IN ('Bash', 'Read') THEN 'native' ELSE 'other' END AS class FROM c)"""


def _classed(s, d):
    return _calls(s, d).withColumn("class", S.tool_class(F.col("tool"), F.col("command"), F.col("file")))


def _messages(s, d):
    n = F.length("text").cast("bigint")
    block = lambda t: F.struct(F.lit(t).alias("type"), F.col("turn").cast("string").alias("id"), F.lit("dev.shell").alias("name"), F.lit("{}").alias("input"), F.left("text", F.lit(5)).alias("text"))
    return table(s, d, "conversations").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("idx"), (F.col("turn") * 61 + F.col("conv_id")).cast("string").alias("ts"), "role",
        F.array(block("text"), block("toolRequest")).alias("content"), F.struct(F.when(n % 4 != 0, n).alias("input_tokens"), (n % 100).alias("output_tokens"), (n % 7).alias("cache_creation_input_tokens"), F.lit(None).cast("bigint").alias("cache_read_input_tokens")).alias("usage"),
    )


def _runs(s, d):
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("run_id"), F.col("o_orderpriority").alias("condition"), F.col("o_totalprice").alias("score"), (F.col("o_totalprice") / 1000).cast("int").cast("double").alias("quality"), (k % 10 / 10.0).cast("double").alias("reliability"), (k % 97).cast("double").alias("cost"), F.col("o_orderstatus").alias("model"), F.when(k % 2 == 0, "mcp").otherwise("native").alias("toolset"), (k % 3).alias("v1"), F.when(k % 4 == 0, k % 5).alias("v2"))


_RUNS = "r AS (SELECT o_orderkey AS run_id, o_orderpriority AS condition, o_totalprice AS score, CAST(trunc(o_totalprice / 1000) AS DOUBLE) AS quality, (o_orderkey % 10) / 10.0 AS reliability, CAST(o_orderkey % 97 AS DOUBLE) AS cost, o_orderstatus AS model, CASE WHEN o_orderkey % 2 = 0 THEN 'mcp' ELSE 'native' END AS toolset, o_orderkey % 3 AS v1, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 5 END AS v2 FROM orders)"


def _stats(s, d, odd):
    return S.stats(_runs(s, d).filter(F.col("run_id") % 2 == odd), "quality").select("condition", "median")


def _checks(s, d):
    r = table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), *[(F.col("o_orderkey") % m != 0).alias(f"c{m}") for m in (2, 3, 5, 7, 11)], F.when(F.col("o_orderkey") % 4 > 0, F.array_repeat(F.lit("f"), (F.col("o_orderkey") % 4).cast("int"))).alias("files"))
    return S.checks(r, ["c2", "c3", "c5", "c7", "c11"]).select("run_id", "ok", "n_files")


def _handoffs(s, d):
    x = _sessions(s, d).withColumn("k", F.regexp_extract("session_id", r"(\d+)$", 1).cast("bigint"))
    part = lambda m, c: x.filter(F.col("k") % m != 0).select("session_id", c)
    return S.handoffs(part(3, "complexity"), part(4, "pr_url"), part(5, "verdict"))


def _costs(s, d):
    t = S.token_sums(_messages(s, d)).withColumn("provider", F.lit("p")).withColumn("model", F.when(F.col("session") % 3 == 0, "large").when(F.col("session") % 3 == 1, "small").otherwise("free"))
    return S.costs(t, s.createDataFrame([("p", "large", 3.0, 15.0), ("p", "small", 0.25, 1.25)], "provider string, model string, price_in double, price_out double"))


def _converted(s, d):
    c = S.convert(_messages(s, d).withColumn("usage", F.struct("usage.input_tokens", "usage.output_tokens")))
    return c.select("session", "idx", F.array_join(F.transform("content", lambda x: x["type"]), ",").alias("types"), "usage.input_tokens", "usage.output_tokens")


QUERIES = {
    "p18_tool_classes": lambda s, d: _classed(s, d).groupBy("class").agg(F.count(F.lit(1)).alias("n")),
    "p19_p30_tool_kinds": lambda s, d: _calls(s, d).groupBy(S.tool_kind(F.col("tool")).alias("kind"), S.structural_search(F.col("tool"), F.col("command")).alias("structural")).agg(F.count(F.lit(1)).alias("n")),
    "p20_validation": lambda s, d: S.validate(_classed(s, d), 3).withColumn("issues", F.array_join("issues", "; ")),
    "e19_tool_calls": lambda s, d: S.tool_calls(_messages(s, d)),
    "a24_verdicts": lambda s, d: S.verdicts(_sessions(s, d)),
    "a25_retry_rate": lambda s, d: S.retry_rate(_sessions(s, d)),
    "a26_pr_success": lambda s, d: S.pr_success(_sessions(s, d)),
    "a27_complexity": lambda s, d: S.complexity(_sessions(s, d)),
    "a28_session_trend": lambda s, d: S.session_trend(_sessions(s, d)),
    "a29_calls_by_tool": lambda s, d: S.calls_by_tool(_calls(s, d)),
    "a30_token_sums": lambda s, d: S.token_sums(_messages(s, d)),
    "a31_f22_wall_time": lambda s, d: S.wall_time(_messages(s, d)),
    "a32_a38_f23_parameters": lambda s, d: S.parameter_usage(_calls(s, d), "analyze_file"),
    "a33_stats": lambda s, d: S.stats(_runs(s, d), "score"),
    "a34_factorial": lambda s, d: S.factorial(_runs(s, d), "model", "toolset", ["mcp", "native"], "score"),
    "a35_effective_cost": lambda s, d: S.effective_cost(_runs(s, d)),
    "a36_violations": lambda s, d: S.violations(_runs(s, d), ["v1", "v2"]),
    "a37_w4_j18_rank_tests": lambda s, d: S.rank_tests(_runs(s, d), "quality"),
    "a41_a42_checks": _checks,
    "j13_handoffs": _handoffs,
    "j14_session_messages": lambda s, d: _messages(s, d).select("session", "idx", "role").join(_calls(s, d).select("session", "condition").distinct(), "session").groupBy("condition", "role").agg(F.count(F.lit(1)).alias("n")),
    "j15_deltas": lambda s, d: S.deltas(_stats(s, d, 0), _stats(s, d, 1), "median"),
    "u7_u8_u9_tools_used": lambda s, d: S.tools_used(_calls(s, d)),
    "f19_costs": _costs,
    "k10_w11_converted": _converted,
}

_CV = "FROM conversations WHERE role = 'assistant'"
_TOK = "t AS (SELECT conv_id AS session, CAST(sum(CASE WHEN length(text) % 4 <> 0 THEN length(text) ELSE 0 END) AS BIGINT) AS input_tokens, CAST(sum(length(text) % 100) AS BIGINT) AS output_tokens, CAST(sum(length(text) % 7) AS BIGINT) AS cache_creation_input_tokens, CAST(0 AS BIGINT) AS cache_read_input_tokens FROM conversations WHERE role = 'assistant' GROUP BY conv_id)"
_P = "round(coalesce(100.0 * {0} / nullif({1}, 0), 0), 2)"

ORACLES = {
    "j13_handoffs": f"""WITH {_SESSIONS}, k AS (SELECT *, CAST(regexp_extract(session_id, '(\\d+)$', 1) AS BIGINT) AS k FROM s)
 SELECT coalesce(a.session_id, b.session_id, c.session_id) AS session_id, complexity, pr_url, verdict FROM (SELECT session_id, complexity FROM k WHERE k % 3 <> 0) a FULL OUTER JOIN (SELECT session_id, pr_url FROM k WHERE k % 4 <> 0) b ON a.session_id = b.session_id
 FULL OUTER JOIN (SELECT session_id, verdict FROM k WHERE k % 5 <> 0) c ON c.session_id = coalesce(a.session_id, b.session_id)""",
    "p18_tool_classes": f"WITH {_CALLS} SELECT class, count(*) AS n FROM k GROUP BY 1",
    "p19_p30_tool_kinds": f"WITH {_CALLS} SELECT CASE WHEN starts_with(tool, 'analyze') THEN 'analyze' WHEN tool IN ('Bash', 'ext__shell') THEN 'shell' ELSE 'editor' END AS kind, tool IN ('Bash', 'ext__shell') AND command = 'rg ''fn main''' AS structural, count(*) AS n FROM c GROUP BY 1, 2",
    "p20_validation": f"""WITH {_CALLS}, g AS (SELECT session, condition, count_if(class = 'mcp') AS mcp, count_if(class = 'native') AS native, count_if(class IN ('mcp', 'native')) AS research FROM k GROUP BY 1, 2),
 i AS (SELECT *, list_filter([CASE WHEN condition <> 'B' AND native = 0 THEN 'ERROR: no native tools' END, CASE WHEN condition <> 'B' AND mcp > 0 THEN 'ERROR: MCP tools used' END, CASE WHEN condition = 'B' AND mcp = 0 THEN 'ERROR: no MCP tools' END, CASE WHEN condition = 'B' AND native > 0 THEN 'ERROR: native tools used' END, CASE WHEN research > 3 THEN 'WARN: research calls ' || research END], lambda x: x IS NOT NULL) AS l FROM g)
 SELECT session, condition, mcp, native, research, array_to_string(l, '; ') AS issues, len(list_filter(l, lambda x: starts_with(x, 'ERROR'))) = 0 AS valid FROM i""",
    "e19_tool_calls": f"SELECT conv_id AS session, turn AS idx, CAST(1 AS INTEGER) AS pos, 'dev__shell' AS tool, '{{}}' AS input {_CV}",
    "a24_verdicts": f"WITH {_SESSIONS} SELECT coalesce(verdict, 'UNKNOWN') AS verdict, count(*) AS n FROM s GROUP BY 1",
    "a25_retry_rate": f"WITH {_SESSIONS} SELECT count(*) AS total, count_if(retry) AS retries, {_P.format('count_if(retry)', 'count(*)')} AS rate FROM s",
    "a26_pr_success": f"WITH {_SESSIONS} SELECT count(*) AS total, count_if(NOT incomplete) AS completed, count_if(NOT incomplete AND pr_url IS NOT NULL) AS with_pr, {_P.format('count_if(NOT incomplete AND pr_url IS NOT NULL)', 'count(*)')} AS rate FROM s",
    "a27_complexity": f"WITH {_SESSIONS} SELECT coalesce(complexity, 'other') AS complexity, count(*) AS n FROM s GROUP BY 1",
    "a28_session_trend": f"WITH {_SESSIONS} SELECT regexp_extract(session_id, '^(\\d{{8}})', 1) AS day, count(*) AS total, count_if(NOT incomplete) AS completed, count_if(NOT incomplete AND verdict = 'PASS') AS passed, count_if(NOT incomplete AND verdict = 'FAIL') AS failed, count_if(incomplete) AS incomplete, count_if(retry) AS retry, {_P.format("count_if(NOT incomplete AND verdict = 'PASS')", 'count_if(NOT incomplete)')} AS pass_pct FROM s WHERE session_id NOT LIKE 'x-%' GROUP BY 1",
    "a29_calls_by_tool": f"WITH {_CALLS} SELECT session, tool, count(*) AS n FROM c GROUP BY 1, 2",
    "a30_token_sums": f"WITH {_TOK} SELECT * FROM t",
    "a31_f22_wall_time": "SELECT conv_id AS session, CAST((arg_max(turn, turn) - arg_min(turn, turn)) * 61 AS BIGINT) AS wall_s FROM conversations GROUP BY 1",
    "a32_a38_f23_parameters": f"WITH {_CALLS}, g AS (SELECT session, count_if(n % 3 = 0) AS s, count_if(n % 5 = 0) AS u FROM c WHERE tool = 'analyze_file' GROUP BY 1) SELECT count(*) AS runs, CAST(sum(s) AS BIGINT) AS summary, CAST(sum(u) AS BIGINT) AS cursor, CAST(0 AS BIGINT) AS page_size, CAST(round(100.0 * count_if(s > 0) / count(*)) AS BIGINT) AS summary_pct, CAST(round(100.0 * count_if(u > 0) / count(*)) AS BIGINT) AS cursor_pct, CAST(0 AS BIGINT) AS page_size_pct FROM g",
    "a33_stats": f"WITH {_RUNS} SELECT condition, median(score) AS median, min(score) AS min, max(score) AS max, round(avg(score), 4) AS mean, count(score) AS n FROM r GROUP BY 1",
    "a34_factorial": f"WITH {_RUNS} SELECT model, median(score) FILTER (toolset = 'mcp') AS mcp, median(score) FILTER (toolset = 'native') AS native FROM r GROUP BY 1",
    "a35_effective_cost": f"WITH {_RUNS} SELECT condition, round(median(cost) / (median(quality) * avg(reliability)), 4) AS effective_cost FROM r GROUP BY 1",
    "a36_violations": f"WITH {_RUNS} SELECT condition, CAST(sum(v1) AS BIGINT) AS v1, CAST(sum(coalesce(v2, 0)) AS BIGINT) AS v2 FROM r GROUP BY 1",
    "a37_w4_j18_rank_tests": f"""WITH {_RUNS}, p AS (SELECT x.condition AS a, y.condition AS b FROM (SELECT DISTINCT condition FROM r) x JOIN (SELECT DISTINCT condition FROM r) y ON x.condition < y.condition),
 j AS (SELECT a, b, condition, quality, rank() OVER (PARTITION BY a, b ORDER BY quality) + (count(*) OVER (PARTITION BY a, b, quality) - 1) / 2.0 AS rk FROM p JOIN r ON condition IN (a, b)),
 s AS (SELECT a, b, count_if(condition = a) AS n1, count_if(condition = b) AS n2, sum(CASE WHEN condition = a THEN rk ELSE 0 END) AS r1 FROM j GROUP BY 1, 2), u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u FROM s)
 SELECT a, b, n1, n2, CAST(u AS DOUBLE) AS u, round((u - n1 * n2 / 2.0) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0), 4) AS z, round(CAST(1 - 2 * u / (n1 * n2) AS DOUBLE), 4) AS r FROM u""",
    "a41_a42_checks": "SELECT o_orderkey AS run_id, o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS ok, CAST(o_orderkey % 4 AS INTEGER) AS n_files FROM orders",
    "j14_session_messages": f"WITH {_CALLS} SELECT ['A', 'A2', 'B'][conv_id % 3 + 1] AS condition, role, count(*) AS n FROM conversations GROUP BY 1, 2",
    "j15_deltas": f"WITH {_RUNS}, x AS (SELECT condition, median(quality) FILTER (run_id % 2 = 0) AS median, median(quality) FILTER (run_id % 2 = 1) AS base FROM r GROUP BY 1) SELECT *, median - base AS delta FROM x",
    "u7_u8_u9_tools_used": f"WITH {_CALLS}, g AS (SELECT DISTINCT session, tool FROM c) SELECT session, string_agg(tool, ',' ORDER BY tool) AS tools, coalesce(string_agg(tool, ',' ORDER BY tool) FILTER (tool IN ('Bash', 'Read')), '') AS native, coalesce(string_agg(tool, ',' ORDER BY tool) FILTER (tool NOT IN ('Bash', 'Read')), '') AS others FROM g GROUP BY 1",
    "f19_costs": f"WITH {_TOK} SELECT session, round(CASE session % 3 WHEN 0 THEN (input_tokens * 3.0 + output_tokens * 15.0) / 1000000.0 WHEN 1 THEN (input_tokens * 0.25 + output_tokens * 1.25) / 1000000.0 ELSE 0.0 END, 6) AS cost_usd FROM t",
    "k10_w11_converted": "WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'assistant' THEN 0 ELSE 1 END, turn) AS rn, CAST(coalesce(sum(CASE WHEN length(text) % 4 <> 0 THEN length(text) END) OVER (PARTITION BY conv_id), 0) AS BIGINT) AS i, CAST(sum(length(text) % 100) OVER (PARTITION BY conv_id) AS BIGINT) AS o FROM conversations) SELECT conv_id AS session, turn AS idx, 'text,tool_use' AS types, CASE WHEN rn = 1 AND role = 'assistant' THEN i END AS input_tokens, CASE WHEN rn = 1 AND role = 'assistant' THEN o END AS output_tokens FROM c",
}
