"""Corpus program: scans, predicates, rollups, top-k and pages over documents and pages as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import paths, scalars
from lodestone.operators import corpus as C
from lodestone.plans.adapters import IMPORTS, SOURCES, imports, sources
from lodestone.session import table

_LANG = "CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.rs' THEN 'rust' WHEN path LIKE '%.md' THEN 'markdown' WHEN path LIKE '%.ts' THEN 'typescript' ELSE 'txt' END"
_LINES = "CAST(len(string_split(content, chr(10))) - CASE WHEN content = '' OR ends_with(content, chr(10)) THEN 1 ELSE 0 END AS BIGINT)"
_TEST = "(path LIKE '%/tests/%' OR path LIKE '%.test.ts')"
_F = f"WITH {SOURCES}, f AS (SELECT path, {_LANG} AS language, {_LINES} AS line_count, CAST(len(regexp_extract_all(content, '(?m)^The')) AS BIGINT) AS function_count, CAST(len(regexp_extract_all(content, '(?m)^And')) AS BIGINT) AS class_count, {_TEST} AS is_test FROM s) "
_DIRS = "SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/') AS path FROM {0}, range(1, 8) t(n) WHERE n < len(string_split(path, '/'))"
_E = _F + f", e AS (SELECT path, false AS is_dir FROM f UNION ALL SELECT path, true FROM ({_DIRS.format('f')})) "

# Functions and classes with line ranges: a lineitem is a function of its order's file, a finished order has a class.
_FUNCS = "fn AS (SELECT 'o' || l_orderkey AS path, 'f' || l_linenumber AS name, CAST(l_linenumber * 10 AS BIGINT) AS line, CAST(l_linenumber * 10 + l_quantity % 9 AS BIGINT) AS end_line FROM lineitem), cl AS (SELECT 'o' || o_orderkey AS path, 'K' AS name, CAST(15 AS BIGINT) AS line, CAST(15 + o_orderkey % 40 AS BIGINT) AS end_line FROM orders WHERE o_orderstatus = 'F')"


def _functions(spark, d):
    li = table(spark, d, "lineitem")
    line = (F.col("l_linenumber") * 10).cast("bigint")
    return li.select(F.concat(F.lit("o"), "l_orderkey").alias("path"), F.concat(F.lit("f"), "l_linenumber").alias("name"), line.alias("line"), (line + (F.col("l_quantity") % 9).cast("bigint")).alias("end_line"))


def _classes(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return o.select(F.concat(F.lit("o"), "o_orderkey").alias("path"), F.lit("K").alias("name"), F.lit(15).cast("bigint").alias("line"), (F.lit(15) + F.col("o_orderkey") % 40).cast("bigint").alias("end_line"))


def _sites(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("o"), "l_orderkey").alias("path"), (F.col("l_linenumber") * 10 + F.col("l_partkey") % 10).cast("bigint").alias("line"), F.col("l_partkey").alias("site"))


def _files(spark, d):
    return C.files(sources(spark, d))


def _changed(spark, d):
    return C.changed_only(C.entries(_files(spark, d)).drop("depth"), sources(spark, d).filter("ord % 10 = 0").select("path"))


def _page(spark, d):
    rows, _, total = C.page(_files(spark, d).select("path", "line_count"), ["path"], 100, 50)
    return rows.withColumn("total", F.lit(total).cast("bigint")).withColumn("next_cursor", scalars.encode_cursor(F.lit("default"), F.lit(150)))


def _scalars(spark, d):
    p = table(spark, d, "part")
    name, k = F.col("p_name"), F.col("p_partkey")
    return p.select(
        "p_partkey",
        scalars.compact_signature(F.lower(F.split(name, " ")[0]), F.array(name, F.concat(F.lit("x: "), "p_type")), F.when(k % 2 == 0, F.lit("i32")), k, k + F.col("p_size")).alias("signature"),
        scalars.strip_scope(F.when(k % 3 == 0, F.concat(F.lit("a::b::"), "p_brand")).when(k % 3 == 1, F.concat(F.lit("self."), "p_brand")).otherwise(F.col("p_brand"))).alias("bare"),
        scalars.info_parts(k % 4, k % 3, k % 2).alias("info"),
        scalars.call_marker(name, F.col("p_size")).alias("marked"),
        scalars.token_estimate(F.length(name)).alias("tokens"),
        scalars.ms_to_human(k * 977).alias("human"),
        F.round(scalars.pct(k % 7, k % 5), 4).alias("pct"),
        scalars.cut_bytes(F.repeat(name, F.lit(5))).alias("cut"),
        scalars.common_prefix(name, F.col("p_type")).alias("prefix"),
        scalars.run_condition(F.when(k % 2 == 0, F.concat(F.lit("A2_"), k.cast("string"))).otherwise(F.concat(F.lit("B"), k.cast("string")))).alias("condition"),
        scalars.utc_day(k * 86_400_000 * 3).alias("day"),
        scalars.tail(name, 6).alias("tail"),
    )


QUERIES = {
    "s5_p6_f6_sources": lambda s, d: _files(s, d),
    "s4_eligible": lambda s, d: C.eligible(sources(s, d).withColumn("content", F.col("content").cast("binary"))).select("path", F.octet_length("content").cast("bigint").alias("n_bytes")),
    "p2_p3_depth": lambda s, d: C.entries(_files(s, d)).filter("depth <= 2").groupBy("depth", "is_dir").count(),
    "p4_excluded": lambda s, d: sources(s, d).filter(paths.is_excluded(F.col("path"))).select("path"),
    "p5_j8_changed": _changed,
    "p8_tests": lambda s, d: _files(s, d).filter("is_test").select("path"),
    "p14_top_level": lambda s, d: C.top_level(_functions(s, d), _classes(s, d)),
    "p15_import_lookup": lambda s, d: C.import_lookup(imports(s, d).select(F.col("page_id").alias("path"), "module", "line", F.array("module").alias("items")), "/the").select("path", "module", "line"),
    "a1_totals": lambda s, d: C.totals(_files(s, d)),
    "a2_languages": lambda s, d: C.by_language(_files(s, d)),
    "a3_primary_language": lambda s, d: C.primary_language(_files(s, d)),
    "a4_j9_directories": lambda s, d: C.by_directory(_files(s, d)),
    "a5_j10_subtrees": lambda s, d: C.subtree_counts(_files(s, d)),
    "a11_imports": lambda s, d: C.import_counts(imports(s, d)),
    "j1_structure": lambda s, d: C.structure(C.entries(_files(s, d)), _files(s, d)).select("path", "is_dir", "line_count"),
    "j6_o13_methods": lambda s, d: C.methods(_functions(s, d), _classes(s, d), 2),
    "j7_e17_enclosing": lambda s, d: C.enclosing(_sites(s, d), _functions(s, d)),
    "o2_top_files": lambda s, d: C.top_files(_files(s, d)),
    "o3_largest_functions": lambda s, d: C.largest_functions(_functions(s, d)),
    "o5_p23_f7_page": _page,
    "o11_sub_directories": lambda s, d: C.sub_directories(_files(s, d)),
    "o12_largest_directory": lambda s, d: C.largest_directory(_files(s, d)),
    "s14_path_completion": lambda s, d: C.complete_paths(C.entries(_files(s, d)), "src1/en", "doc_1").select("path", "is_dir"),
    "p28_symbol_completion": lambda s, d: C.complete_symbols(_functions(s, d), _classes(s, d), "f1").select("name"),
    "f_scalars": _scalars,
}

ORACLES = {
    "s5_p6_f6_sources": _F + "SELECT * FROM f",
    "s4_eligible": f"WITH {SOURCES} SELECT path, CAST(strlen(content) AS BIGINT) AS n_bytes FROM s WHERE strlen(content) <= 10000000",
    "p2_p3_depth": _E + "SELECT CAST(len(string_split(path, '/')) AS INTEGER) AS depth, is_dir, count(*) AS count FROM e WHERE len(string_split(path, '/')) <= 2 GROUP BY 1, 2",
    "p4_excluded": f"WITH {SOURCES} SELECT path FROM s WHERE list_has_any(string_split(path, '/'), {list(paths.EXCLUDED)})",
    "p5_j8_changed": _E + f", c AS (SELECT path FROM s WHERE ord % 10 = 0) SELECT path, is_dir FROM e WHERE NOT is_dir AND path IN (SELECT path FROM c) UNION ALL SELECT path, is_dir FROM e WHERE is_dir AND path IN ({_DIRS.format('c')})",
    "p8_tests": _F + "SELECT path FROM f WHERE is_test",
    "p14_top_level": f"WITH {_FUNCS} SELECT * FROM fn WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.path = fn.path AND fn.line >= cl.line AND fn.end_line <= cl.end_line)",
    "p15_import_lookup": f"WITH {IMPORTS} SELECT page_id AS path, module, min(line) AS line FROM i WHERE module = '/the' GROUP BY 1, 2",
    "a1_totals": _F + "SELECT count(*) AS files, CAST(sum(line_count) AS BIGINT) AS loc, CAST(sum(function_count) AS BIGINT) AS functions, CAST(sum(class_count) AS BIGINT) AS classes, count_if(NOT is_test) AS prod, count_if(is_test) AS test FROM f",
    "a2_languages": _F + "SELECT language, count(*) AS files, CAST(count(*) * 100 // sum(count(*)) OVER () AS BIGINT) AS percent FROM f GROUP BY language",
    "a3_primary_language": _F + "SELECT language, count(*) AS files FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "a4_j9_directories": _F + "SELECT string_split(path, '/')[1] AS dir, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS loc, CAST(sum(function_count) AS BIGINT) AS functions, CAST(sum(class_count) AS BIGINT) AS classes FROM f GROUP BY 1",
    "a5_j10_subtrees": _F + "SELECT string_split(path, '/')[1] AS component, count(*) AS n FROM f WHERE path NOT LIKE '%/node_modules/%' GROUP BY 1",
    "a11_imports": f"WITH {IMPORTS} SELECT module, count(*) AS n FROM i GROUP BY 1",
    "j1_structure": _E + "SELECT e.path, e.is_dir, f.line_count FROM e LEFT JOIN f ON e.path = f.path",
    "j6_o13_methods": f"WITH {_FUNCS}, j AS (SELECT cl.path, cl.name AS class, fn.name AS method, fn.line, CAST(row_number() OVER (PARTITION BY cl.path ORDER BY fn.line, fn.name) AS INTEGER) AS rank, greatest(count(*) OVER (PARTITION BY cl.path) - 2, 0) AS more FROM cl JOIN fn ON cl.path = fn.path AND fn.line >= cl.line AND fn.end_line <= cl.end_line) SELECT * FROM j WHERE rank <= 2",
    "j7_e17_enclosing": f"WITH {_FUNCS}, x AS (SELECT DISTINCT 'o' || l_orderkey AS path, CAST(l_linenumber * 10 + l_partkey % 10 AS BIGINT) AS line, l_partkey AS site FROM lineitem) SELECT x.path, x.line, x.site, coalesce(arg_max(fn.name, fn.line), '<module>') AS caller FROM x LEFT JOIN fn ON x.path = fn.path AND x.line BETWEEN fn.line AND fn.end_line GROUP BY 1, 2, 3",
    "o2_top_files": _F + ", g AS (SELECT *, string_split(path, '/')[1] AS dir, max(class_count) OVER (PARTITION BY string_split(path, '/')[1]) AS mc FROM f), r AS (SELECT dir, CAST(row_number() OVER (PARTITION BY dir ORDER BY CASE WHEN mc > 0 THEN class_count ELSE 0 END DESC, function_count DESC, path) AS INTEGER) AS rank, path, class_count, function_count FROM g) SELECT * FROM r WHERE rank <= 3 AND (class_count > 0 OR function_count > 0)",
    "o3_largest_functions": f"WITH {_FUNCS} SELECT *, greatest(end_line - line, 0) AS span FROM fn ORDER BY span DESC, path, line, name LIMIT 10",
    "o5_p23_f7_page": _F + """SELECT path, line_count, (SELECT count(*) FROM f) AS total, to_base64(encode('{"mode":"default","offset":150}')) AS next_cursor FROM f ORDER BY path LIMIT 50 OFFSET 100""",
    "o11_sub_directories": _F + "SELECT dir, string_agg(sub, ',' ORDER BY sub) AS subs FROM (SELECT DISTINCT string_split(path, '/')[1] AS dir, string_split(path, '/')[2] AS sub, dense_rank() OVER (PARTITION BY string_split(path, '/')[1] ORDER BY string_split(path, '/')[2]) AS k FROM f WHERE len(string_split(path, '/')) > 2) WHERE k <= 5 GROUP BY dir",
    "o12_largest_directory": _F + "SELECT string_split(path, '/')[1] AS component, count(*) AS n FROM f WHERE path NOT LIKE '%/node_modules/%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "s14_path_completion": _E + "SELECT path, is_dir FROM e WHERE regexp_replace(path, '/?[^/]*$', '') = 'src1/en' AND starts_with(path, 'src1/en/doc_1') ORDER BY path LIMIT 100",
    "p28_symbol_completion": f"WITH {_FUNCS} SELECT name FROM fn WHERE starts_with(name, 'f1') ORDER BY line, name LIMIT 100",
    "f_scalars": """SELECT p_partkey,
 (CASE WHEN strlen(sg) > 80 THEN left(sg, 77) || '...' ELSE sg END) || ' :' || p_partkey || '-' || (p_partkey + p_size) AS signature,
 p_brand AS bare, '[' || nullif(array_to_string(list_filter([CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 4) || 'L' END, CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 3) || 'F' END, CASE WHEN p_partkey % 2 > 0 THEN (p_partkey % 2) || 'C' END], lambda x: x IS NOT NULL), ', '), '') || ']' AS info,
 CASE WHEN p_size > 3 THEN p_name || '•' || p_size ELSE p_name END AS marked, CAST(length(p_name) // 4 AS BIGINT) AS tokens,
 CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1fs', ms / 1000.0) WHEN ms < 3600000 THEN (ms // 60000) || 'm ' || (ms // 1000 % 60) || 's' ELSE (ms // 3600000) || 'h ' || (ms // 60000 % 60) || 'm' END AS human,
 round(coalesce(100.0 * (p_partkey % 7) / nullif(p_partkey % 5, 0), 0), 4) AS pct,
 CASE WHEN strlen(repeat(p_name, 5)) > 80 THEN left(repeat(p_name, 5), 77) || '...' ELSE repeat(p_name, 5) END AS cut,
 CAST((SELECT coalesce(max(n), 0) FROM range(0, 30) t(n) WHERE n <= least(length(p_name), length(p_type)) AND left(p_name, n) = left(p_type, n)) AS INTEGER) AS prefix,
 CASE WHEN p_partkey % 2 = 0 THEN 'A2' ELSE 'B' END AS condition, strftime(make_timestamp(p_partkey * 86400000000 * 3), '%Y-%m-%d') AS day, right(p_name, 6) AS tail
 FROM (SELECT *, lower(string_split(p_name, ' ')[1]) || '(' || p_name || ', x: ' || p_type || ')' || CASE WHEN p_partkey % 2 = 0 THEN ' -> i32' ELSE '' END AS sg, p_partkey * 977 AS ms FROM part)""",
}
