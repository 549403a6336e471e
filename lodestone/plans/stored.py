"""Stores program: the driver's tables written to a shared folder by the sinks, and read back by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import corpus
from lodestone.operators import text as T
from lodestone.plans.adapters import DEFINITIONS, EDGES, METRICS, definitions, edges, metric_events
from lodestone.session import shared_folder, table
from lodestone.sources import files, listing, stores


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


def _log(s, d) -> DataFrame:
    top = _folder(s)
    stores.log_events(metric_events(s, d).select("ts", "tool", "duration_ms", "output_chars", "result", "session_id", "exit_code"), top)
    return files.metric_log(s, top, "2024-01-10", "2024-01-20").select(F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd").alias("day"), "tool", "duration_ms", "result", "session_id", "exit_code")


def _transcripts(s, d) -> DataFrame:
    """Each message a line of JSON; after every seventh conversation's turns a broken one."""
    c = table(s, d, "conversations")
    said = F.struct(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")).alias("x"))["x"]
    usage = F.struct((F.col("conv_id") % 100).alias("input_tokens"), F.col("turn").cast("bigint").alias("output_tokens"))
    line = F.to_json(F.struct(F.col("role").alias("type"), F.concat_ws(":", "conv_id", "turn").alias("timestamp"), F.struct("role", F.array(said).alias("content"), usage.alias("usage")).alias("message")))
    top = _folder(s)
    c.select(F.explode(F.when(F.col("conv_id") % 7 == 0, F.array(line, F.lit('{"type": broken'))).otherwise(F.array(line))).alias("value")).write.text(top)
    t = files.transcripts(s, top)
    return t.filter("role is not null").select("ts", "role", F.col("content")[0]["text"].alias("text"), "usage.input_tokens", "usage.output_tokens")


def _scores(s, d) -> DataFrame:
    """An object for each fifty suppliers, with a run for each."""
    top = _folder(s)
    run = F.struct(F.concat(F.lit("run"), "s_suppkey").alias("key"), F.struct(F.concat(F.lit("C"), "s_nationkey").alias("condition"), F.create_map(F.lit("cost"), F.col("s_acctbal"), F.lit("key"), F.col("s_suppkey").cast("double")).alias("scores")).alias("value"))
    part = F.floor(F.col("s_suppkey") / 50)
    objects = table(s, d, "supplier").groupBy(part.alias("part")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(run)).alias("runs"))).alias("content"))
    listing.write_tree(objects.select(F.concat(F.lit("scores"), "part", F.lit(".json")).alias("path"), "content"), top)
    return files.scores(s, top).select("run_id", "condition", F.round(F.col("scores")["cost"], 2).alias("cost"))


def _cached(s, d) -> DataFrame:
    top = _folder(s)
    for name, key in (("region", "aa11"), ("nation", "bb22"), ("supplier", "bb33")):
        stores.put_cached(table(s, d, name).select(F.col(f"{name[0]}_name").alias("name")), top, "analyze_file", key)
    return stores.get_cached(s, top, "analyze_file", "bb22").unionByName(stores.get_cached(s, top, "analyze_file", "bb33").filter("name like '%1'"))


def _graph(s, d) -> DataFrame:
    top = _folder(s)
    stores.put_graph(definitions(s, d), edges(s, d).select("caller", "callee"), top)
    nodes, e = stores.get_graph(s, top)
    return nodes.groupBy("kind").count().unionByName(e.agg(F.lit("edge").alias("kind"), F.count(F.lit(1)).alias("count")))


def _overflow(s, d) -> DataFrame:
    t = table(s, d, "documents").filter("text is not null")
    lines = F.split("text", "\n", -1)
    return stores.overflow(t.select(F.col("doc_id").alias("run_id"), F.array_join(T.preview(lines, 8, 3), "\n").alias("preview"), F.col("text").alias("full_text"))).select("run_id", "truncated", F.length("preview").alias("shown"), F.length("full_text").alias("whole"))


def _fresh(s, d) -> DataFrame:
    top = _folder(s)
    table(s, d, "orders").select("o_orderkey").write.parquet(top)
    return stores.fresh(s, top, 1).agg(F.count(F.lit(1)).alias("n"))


def _projected(s, d) -> DataFrame:
    li = table(s, d, "lineitem")
    a = li.groupBy(F.col("l_orderkey").alias("path")).agg(F.collect_list(F.col("l_linenumber").cast("string")).alias("functions"), F.collect_set("l_suppkey").alias("classes"), F.collect_list("l_returnflag").alias("imports"))
    a = a.withColumn("call_frequency", F.create_map(F.lit("f"), F.size("functions")))
    keep = corpus.project_fields(a, ["classes"]).select("path", F.size("functions").alias("f"), F.size("classes").alias("c"), F.size("imports").alias("i"), F.size("call_frequency").alias("q"))
    return keep


def _tree(s, d) -> DataFrame:
    """A folder for each nation, seven below it, three files a supplier: one hidden, one by its name ignored or kept again; rules in the top folder and in one below."""
    top = _folder(s)
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    at = F.concat(F.lit("n"), n, F.lit("/s"), k % 7, F.lit("/"))
    names = F.array(F.concat(at, F.lit("f"), k, F.lit(".txt")), F.concat(at, F.when(k % 5 == 0, "keep").otherwise("t"), k, F.lit(".log")), F.concat(at, F.lit(".h"), k))
    own = table(s, d, "supplier").select(F.explode(names).alias("path"), F.col("s_name").alias("content"))
    rules = s.createDataFrame([(".gitignore", "# logs\n*.log\n!keep*.log\n/n3/s1/\ns2/\n"), ("n4/.ignore", "!s2/\nf*.txt\n")], "path string, content string")
    listing.write_tree(own.unionByName(rules), top)
    return listing.entries(s, top, most=None).select("path", "depth", "is_dir")


QUERIES = {
    "s1_s2_tree": _tree,
    "s6_k1_metric_log": _log,
    "s9_transcripts": _transcripts,
    "s10_scores": _scores,
    "s12_k7_cached": _cached,
    "s13_k8_graph": _graph,
    "k9_overflow": _overflow,
    "k11_fresh": _fresh,
    "p1_projected": _projected,
}

_SPLIT = "string_split(text, chr(10))"
_SHOWN = "f AS (SELECT s_suppkey AS k, s_nationkey AS n, 'n' || s_nationkey AS a, 'n' || s_nationkey || '/s' || s_suppkey % 7 AS b FROM supplier), v AS (SELECT * FROM f WHERE NOT (n = 3 AND k % 7 = 1) AND (k % 7 <> 2 OR n = 4))"
ORACLES = {
    "s1_s2_tree": f"WITH {_SHOWN} SELECT DISTINCT a AS path, 1 AS depth, true AS is_dir FROM (SELECT a FROM f UNION ALL SELECT 'n4') UNION ALL SELECT DISTINCT b, 2, true FROM v UNION ALL SELECT b || '/f' || k || '.txt', 3, false FROM v WHERE n <> 4 UNION ALL SELECT b || '/keep' || k || '.log', 3, false FROM v WHERE k % 5 = 0",
    "s6_k1_metric_log": f"WITH {METRICS} SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day, tool, duration_ms, result, session_id, exit_code FROM m WHERE strftime(make_timestamp(ts * 1000), '%Y-%m-%d') BETWEEN '2024-01-10' AND '2024-01-20'",
    "s9_transcripts": "SELECT conv_id || ':' || turn AS ts, role, text, conv_id % 100 AS input_tokens, CAST(turn AS BIGINT) AS output_tokens FROM conversations WHERE role IS NOT NULL",
    "s10_scores": "SELECT 'run' || s_suppkey AS run_id, 'C' || s_nationkey AS condition, round(s_acctbal, 2) AS cost FROM supplier",
    "s12_k7_cached": "SELECT n_name AS name FROM nation UNION ALL SELECT s_name FROM supplier WHERE s_name LIKE '%1'",
    "s13_k8_graph": f"WITH {EDGES}, {DEFINITIONS} SELECT kind, count(*) AS count FROM d GROUP BY 1 UNION ALL SELECT 'edge', count(*) FROM e",
    "k9_overflow": f"SELECT doc_id AS run_id, CAST(length(p) AS INTEGER) AS shown, CAST(length(text) AS INTEGER) AS whole, length(text) > length(p) AS truncated FROM (SELECT doc_id, text, array_to_string(CASE WHEN len({_SPLIT}) > 8 THEN {_SPLIT}[-3:] ELSE {_SPLIT} END, chr(10)) AS p FROM documents WHERE text IS NOT NULL)",
    "k11_fresh": "SELECT count(*) AS n FROM orders",
    "p1_projected": "SELECT l_orderkey AS path, 0 AS f, CAST(count(DISTINCT l_suppkey) AS INTEGER) AS c, 0 AS i, 0 AS q FROM lineitem GROUP BY 1",
}
