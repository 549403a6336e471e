"""The driver's tables as the inputs of the engine: the same views for Spark and, as SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.session import table

#: Event types stand for tools.
TOOLS = {"view": "analyze_file", "click": "analyze_directory", "purchase": "analyze_symbol", "signup": "exec_command", "error": "edit_replace"}


def metric_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """The telemetry log; ``k`` drives the sparse fields. A stream of ``events`` has no sequence numbers."""
    tool = F.coalesce(*[F.when(F.col("event_type") == e, t) for e, t in TOOLS.items()], F.lit("unknown"))
    e = (table(spark, sf_dir, "events") if events is None else events).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    flag = lambda n, t, f: F.when(k % n == t, True).when(k % n == f, False)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("event_id").alias("ord"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        tool.alias("tool"),
        F.round("value").cast("bigint").alias("duration_ms"),
        (k * 100).cast("bigint").alias("output_chars"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("result"),
        F.when(F.col("event_type") == "error", F.when(k % 3 == 0, "invalid_params").when(k % 3 == 1, "internal")).alias("error_type"),
        F.col("user_id").cast("string").alias("session_id"),
        (F.row_number().over(w) - 1 if events is None else F.lit(None).cast("int")).alias("seq"),
        flag(3, 0, 1).alias("cache_hit"),
        F.when(k % 3 == 0, F.when(k % 2 == 0, "l1_memory").otherwise("l2_disk")).alias("cache_tier"),
        (k % 17 == 0).alias("cache_write_failure"),
        F.when(k % 10 == 0, 1).when(k % 2 == 0, 0).alias("exit_code"),
        (k % 25 == 0).alias("timed_out"),
        (k % 4 == 0).alias("output_truncated"),
        flag(5, 0, 1).alias("summary_mode"),
        flag(7, 0, 1).alias("is_paginated"),
        flag(6, 0, 1).alias("fields_projected"),
        flag(9, 0, 1).alias("working_dir_used"),
        flag(11, 0, 1).alias("stdin_provided"),
        flag(8, 0, 1).alias("git_ref_used"),
        F.when(k % 4 == 1, "prefix").when(k % 4 == 2, "contains").alias("match_mode"),
        flag(4, 0, 1).alias("import_lookup"),
        flag(5, 1, 2).alias("def_use"),
        flag(6, 2, 3).alias("impl_only"),
        F.when(k % 3 != 0, (k * k * 20).cast("bigint")).alias("timeout_configured_ms"),
        F.when(k % 8 == 0, F.lit(500).cast("bigint")).alias("drain_timeout_ms"),
    )


def _flag(n: int, t: int, f: int) -> str:
    return f"CASE WHEN k % {n} = {t} THEN true WHEN k % {n} = {f} THEN false END"


METRICS = f"""m0 AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
m AS (SELECT event_id AS ord, epoch_ms(ts) AS ts,
 CASE event_type {' '.join(f"WHEN '{e}' THEN '{t}'" for e, t in TOOLS.items())} ELSE 'unknown' END AS tool,
 CAST(round(value) AS BIGINT) AS duration_ms, CAST(k * 100 AS BIGINT) AS output_chars,
 CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS result,
 CASE WHEN event_type = 'error' THEN CASE k % 3 WHEN 0 THEN 'invalid_params' WHEN 1 THEN 'internal' END END AS error_type,
 CAST(user_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
 {_flag(3, 0, 1)} AS cache_hit, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'l1_memory' ELSE 'l2_disk' END END AS cache_tier,
 k % 17 = 0 AS cache_write_failure, CASE WHEN k % 10 = 0 THEN 1 WHEN k % 2 = 0 THEN 0 END AS exit_code, k % 25 = 0 AS timed_out,
 k % 4 = 0 AS output_truncated, {_flag(5, 0, 1)} AS summary_mode, {_flag(7, 0, 1)} AS is_paginated, {_flag(6, 0, 1)} AS fields_projected,
 {_flag(9, 0, 1)} AS working_dir_used, {_flag(11, 0, 1)} AS stdin_provided, {_flag(8, 0, 1)} AS git_ref_used,
 CASE k % 4 WHEN 1 THEN 'prefix' WHEN 2 THEN 'contains' END AS match_mode, {_flag(4, 0, 1)} AS import_lookup, {_flag(5, 1, 2)} AS def_use,
 {_flag(6, 2, 3)} AS impl_only, CASE WHEN k % 3 <> 0 THEN CAST(k * k * 20 AS BIGINT) END AS timeout_configured_ms,
 CASE WHEN k % 8 = 0 THEN CAST(500 AS BIGINT) END AS drain_timeout_ms FROM m0)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: path, content, ord."""
    ext = F.element_at(F.array(*map(F.lit, ("py", "rs", "md", "test.ts", "txt"))), (F.col("doc_id") % 5 + 1).cast("int"))
    top = F.when(F.col("doc_id") % 7 == 0, F.lit("tests/")).when(F.col("doc_id") % 11 == 0, F.lit("node_modules/")).otherwise("")
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), top, "lang", F.lit("/doc_"), "doc_id", F.lit("."), ext).alias("path"), F.coalesce("text", F.lit("")).alias("content"), F.col("doc_id").alias("ord"))


SOURCES = """s AS (SELECT source || '/' || CASE WHEN doc_id % 7 = 0 THEN 'tests/' WHEN doc_id % 11 = 0 THEN 'node_modules/' ELSE '' END || lang || '/doc_' || doc_id || '.'
 || CASE doc_id % 5 WHEN 0 THEN 'py' WHEN 1 THEN 'rs' WHEN 2 THEN 'md' WHEN 3 THEN 'test.ts' ELSE 'txt' END AS path, coalesce(text, '') AS content, doc_id AS ord FROM documents)"""


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of links and sources in pages, in page order."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id"), F.posexplode(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]+)"'), F.lit(1))).alias("line", "module"))


IMPORTS = """i0 AS (SELECT page_id, regexp_extract_all(html, '(?:href|src)="([^"]+)"', 1) AS ms FROM pages),
i AS (SELECT page_id, CAST(unnest(range(len(ms))) AS INTEGER) AS line, unnest(ms) AS module FROM i0)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic graph over the star schema: caller, callee, path, line, ord (an order within the caller)."""
    t = lambda n: table(spark, sf_dir, n)
    li, o = t("lineitem"), t("orders")
    c_p = o.join(li, o.o_orderkey == li.l_orderkey).select(F.concat(F.lit("C"), "o_custkey").alias("caller"), F.concat(F.lit("P"), "l_partkey").alias("callee"))
    p_s = li.select(F.concat(F.lit("P"), "l_partkey").alias("caller"), F.concat(F.lit("S"), "l_suppkey").alias("callee"))
    s_n = t("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("caller"), F.concat(F.lit("N"), "s_nationkey").alias("callee"))
    n_r = t("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("caller"), F.concat(F.lit("R"), "n_regionkey").alias("callee"))
    n_c = t("customer").select(F.concat(F.lit("N"), "c_nationkey").alias("caller"), F.concat(F.lit("C"), "c_custkey").alias("callee"))
    return c_p.unionByName(p_s).unionByName(s_n).unionByName(n_r).unionByName(n_c).distinct()


EDGES = """e AS (SELECT DISTINCT caller, callee FROM (
 SELECT 'C' || o_custkey AS caller, 'P' || l_partkey AS callee FROM orders JOIN lineitem ON o_orderkey = l_orderkey
 UNION ALL SELECT 'P' || l_partkey, 'S' || l_suppkey FROM lineitem
 UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
 UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
 UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer))"""


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of the graph: name, path, line, kind."""
    t = lambda n: table(spark, sf_dir, n)
    one = lambda n, letter, key, kind: t(n).select(F.concat(F.lit(letter), key).alias("name"), F.lit(f"{n}.rs").alias("path"), F.col(key).cast("bigint").alias("line"), F.lit(kind).alias("kind"))
    return one("part", "P", "p_partkey", "function").unionByName(one("supplier", "S", "s_suppkey", "function")).unionByName(one("customer", "C", "c_custkey", "function")).unionByName(one("nation", "N", "n_nationkey", "class"))


DEFINITIONS = """d AS (SELECT 'P' || p_partkey AS name, 'part.rs' AS path, CAST(p_partkey AS BIGINT) AS line, 'function' AS kind FROM part
 UNION ALL SELECT 'S' || s_suppkey, 'supplier.rs', s_suppkey, 'function' FROM supplier
 UNION ALL SELECT 'C' || c_custkey, 'customer.rs', c_custkey, 'function' FROM customer
 UNION ALL SELECT 'N' || n_nationkey, 'nation.rs', n_nationkey, 'class' FROM nation)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: doc_id, pos from 0, line."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))


LINES = "l0 AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS pos, unnest(ls) AS line FROM l0)"
