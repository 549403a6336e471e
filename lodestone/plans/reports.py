"""Report program: the corpus, its modules and one symbol as lines of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import corpus as C
from lodestone.operators import render as R
from lodestone.operators import requests as Q
from lodestone.operators.focused import focus
from lodestone.plans.adapters import definitions, edges, sources
from lodestone.plans.corpus import _E, _F, _classes, _files, _functions
from lodestone.plans.graph import _BFS, _place
from lodestone.plans.graph import _E as _EDGES
from lodestone.session import table


def _modules(s, d):
    """Orders as modules: each line item is a function, its supplier's group an import with items if it was returned."""
    li = table(s, d, "lineitem")
    line = (F.col("l_linenumber") * 10).cast("bigint")
    f = F.struct(line.alias("line"), F.concat(F.lit("fn_"), "l_linenumber", F.lit("_"), "l_partkey").alias("name"), (line + F.col("l_quantity").cast("bigint") % 9).alias("end_line"), F.array(F.concat(F.lit("x: "), "l_linestatus")).alias("parameters"), F.when(F.col("l_linenumber") % 2 == 0, "i32").alias("return_type"))
    i = F.struct(line.alias("line"), F.concat(F.lit("m"), F.col("l_suppkey") % 7).alias("module"), F.when(F.col("l_returnflag") == "R", F.array("l_returnflag", "l_linestatus")).otherwise(F.array().cast("array<string>")).alias("items"))
    # One line item a number stands for the others, so that the order is certain.
    one = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(f).alias("f"), F.min(i).alias("i"))
    return one.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("f")).alias("functions"), F.array_sort(F.collect_list("i")).alias("imports"), F.count(F.lit(1)).alias("line_count")).withColumn("path", F.concat(F.lit("d/o"), "l_orderkey", F.lit(".rs")))


def _wrapped(s, d):
    sig = F.transform("functions", lambda f: F.concat(f["name"], F.lit("("), f["parameters"][0], F.lit(")")))
    return _modules(s, d).select("path", R.wrapped(sig).alias("text"))


def _focused(s, d):
    defs = definitions(s, d)
    x = focus(defs.filter("kind = 'function'"), defs.filter("kind = 'class'"), edges(s, d).select("caller", "callee", *_place()), "s1", "insensitive", 1)
    side = lambda c, name: R.chain_tree(c).select(F.lit(name).alias("side"), "parent", "child", "n")
    return side(x.production, "callers").unionByName(side(x.outgoing, "callees"))


def _file_ext(s, d):
    f = sources(s, d).select(F.when(F.col("ord") % 13 == 0, F.regexp_replace("path", r"\.[^.]+$", "")).when(F.col("ord") % 13 == 1, F.upper("path")).otherwise(F.col("path")).alias("path"))
    return f.select(F.coalesce(Q.file_ext(F.col("path")), F.lit("-")).alias("ext"), F.coalesce(Q.file_language(F.col("path")), F.lit("-")).alias("language")).groupBy("ext", "language").count()


def _counted(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice") / 5).alias("latency_ms"))
    return Q.counted(o).select("run")


QUERIES = {
    "fmt_structure": lambda s, d: R.structure_lines(C.entries(_files(s, d)), _files(s, d)),
    "fmt_module_info_f27": lambda s, d: _modules(s, d).select("path", R.module_info().alias("text")),
    "w12_wrapped": _wrapped,
    "g7_focused": _focused,
    "f10_file_ext": _file_ext,
    "p31_counted": _counted,
    "fmt_methods_section": lambda s, d: _with_classes(s, d).select("path", R.classes_section(F.col("classes"), F.col("functions")).alias("text")),
}


def _with_classes(s, d):
    f = _functions(s, d).distinct().groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "name", "end_line"))).alias("functions"))
    c = _classes(s, d).groupBy("path").agg(F.collect_list(F.struct("name", "line", "end_line", F.array().cast("array<string>").alias("inherits"))).alias("classes"))
    return c.join(f, "path")


_INFO = "'[' || array_to_string(list_filter([CASE WHEN line_count > 0 THEN line_count || 'L' END, CASE WHEN function_count > 0 THEN function_count || 'F' END, CASE WHEN class_count > 0 THEN class_count || 'C' END], lambda x: x IS NOT NULL), ', ') || ']'"
_SUMS = "coalesce(sum(line_count), 0) || 'L, ' || coalesce(sum(function_count), 0) || 'F, ' || coalesce(sum(class_count), 0) || 'C'"
_M = """WITH a AS (SELECT l_orderkey, l_linenumber, min({'line': l_linenumber * 10, 'name': 'fn_' || l_linenumber || '_' || l_partkey, 'e': l_linenumber * 10 + CAST(l_quantity AS BIGINT) % 9, 'x': 'x: ' || l_linestatus}) AS f FROM lineitem GROUP BY 1, 2),
 b AS (SELECT l_orderkey, l_linenumber, min({'line': l_linenumber * 10, 'module': 'm' || l_suppkey % 7, 'items': CASE WHEN l_returnflag = 'R' THEN [l_returnflag, l_linestatus] ELSE [] END}) AS i FROM lineitem GROUP BY 1, 2),
 m AS (SELECT a.l_orderkey, list(f ORDER BY l_linenumber) AS fs, list(i ORDER BY l_linenumber) AS ims FROM a JOIN b USING (l_orderkey, l_linenumber) GROUP BY 1) """
_IN = "ci AS (SELECT callee AS node, caller AS neighbor, row_number() OVER (PARTITION BY callee ORDER BY left(caller, 1), CAST(caller[2:] AS BIGINT), caller) AS ord FROM e), fi AS (SELECT node, neighbor FROM ci WHERE ord = 1)"
_OUT = "co AS (SELECT caller AS node, callee AS neighbor, row_number() OVER (PARTITION BY caller ORDER BY callee) AS ord FROM e), fo AS (SELECT node, neighbor FROM co WHERE ord = 1)"

ORACLES = {
    "fmt_structure": _E + f""", d AS (SELECT e.path, e.is_dir, len(string_split(e.path, '/')) AS depth, f.* EXCLUDE (path), CASE WHEN line_count + function_count + class_count > 0 THEN {_INFO} END AS info FROM e LEFT JOIN f ON e.path = f.path),
 l AS (SELECT language, count(*) AS n FROM f GROUP BY 1),
 o AS (SELECT 0 AS block, '' AS key, count(*) || ' files, ' || {_SUMS} || ' (' || (SELECT arg_max(language || ' ' || (n * 100 // (SELECT count(*) FROM f)) || '%', {{'n': n, 'l': language}}) FROM l) || ')' AS line FROM f
 UNION ALL SELECT 1, '', 'SUMMARY:' UNION ALL SELECT 2, '', 'Shown: ' || count(*) || ' files (' || count_if(NOT is_test) || ' prod, ' || count_if(is_test) || ' test), ' || {_SUMS} FROM f
 UNION ALL SELECT 3, '', 'Languages: ' || string_agg(language || ' (' || (n * 100 // (SELECT count(*) FROM f)) || '%)', ', ' ORDER BY language) FROM l
 UNION ALL SELECT 4, '', '' UNION ALL SELECT 5, '', 'PATH [LOC, FUNCTIONS, CLASSES]'
 UNION ALL SELECT 6, replace(path, '/', chr(1)), repeat('  ', depth - 1) || string_split(path, '/')[-1] || CASE WHEN is_dir THEN '/' ELSE ' ' || info END FROM d WHERE is_dir OR info IS NOT NULL AND NOT is_test
 UNION ALL SELECT DISTINCT 7, '', '' FROM d WHERE info IS NOT NULL AND is_test UNION ALL SELECT DISTINCT 8, '', 'TEST FILES [LOC, FUNCTIONS, CLASSES]' FROM d WHERE info IS NOT NULL AND is_test
 UNION ALL SELECT 9, replace(path, '/', chr(1)), repeat('  ', depth - 1) || string_split(path, '/')[-1] || ' ' || info FROM d WHERE info IS NOT NULL AND is_test) SELECT CAST(block AS INTEGER) AS block, key, line FROM o""",
    "fmt_module_info_f27": _M + """SELECT 'd/o' || l_orderkey || '.rs' AS path, 'FILE: o' || l_orderkey || '.rs (' || len(fs) || 'L, ' || len(fs) || 'F, ' || len(fs) || 'I)' || chr(10) || 'F:' || chr(10) || '  ' || array_to_string(list_transform(fs, lambda x: x.name || ':' || x.line), ', ') || chr(10)
 || 'I:' || chr(10) || '  ' || array_to_string(list_transform(ims, lambda x: x.module || CASE WHEN len(x.items) > 0 THEN ':' || array_to_string(x.items, ', ') ELSE '' END), '; ') || chr(10) AS text FROM m""",
    "w12_wrapped": _M + """, s AS (SELECT l_orderkey, list_transform(fs, lambda x: x.name || '(' || x.x || ')') AS ss FROM m),
 w AS (SELECT l_orderkey, list_reduce(list_prepend({'o': '', 'l': '  ' || ss[1]}, list_transform(ss[2:], lambda x: {'o': '', 'l': x})), lambda a, x: CASE WHEN strlen(a.l) + strlen(x.l) + 2 > 100 THEN {'o': a.o || a.l || chr(10), 'l': '  ' || x.l} ELSE {'o': a.o, 'l': a.l || ', ' || x.l} END) AS r FROM s)
 SELECT 'd/o' || l_orderkey || '.rs' AS path, r.o || r.l AS text FROM w""",
    "g7_focused": _EDGES + f""", {_IN}, {_OUT}, ri AS (SELECT 'S1' AS node, 0 AS depth UNION SELECT caller, 1 FROM e WHERE callee = 'S1'), ro AS (SELECT 'S1' AS node, 0 AS depth UNION SELECT callee, 1 FROM e WHERE caller = 'S1'),
 i AS (SELECT ci.neighbor AS parent, CASE WHEN ri.depth < 1 AND fi.neighbor IS NOT NULL THEN fi.neighbor ELSE ci.node END AS child FROM (SELECT node, min(depth) AS depth FROM ri GROUP BY 1) ri JOIN ci USING (node) LEFT JOIN fi ON fi.node = ci.neighbor),
 o AS (SELECT co.node AS parent, CASE WHEN ro.depth < 1 AND fo.neighbor IS NOT NULL THEN fo.neighbor ELSE co.neighbor END AS child FROM (SELECT node, min(depth) AS depth FROM ro GROUP BY 1) ro JOIN co USING (node) LEFT JOIN fo ON fo.node = co.neighbor)
 SELECT 'callers' AS side, parent, child, count(*) AS n FROM i GROUP BY 2, 3 UNION ALL SELECT 'callees', parent, child, count(*) FROM o GROUP BY 2, 3""",
    "f10_file_ext": _F + """, p AS (SELECT CASE WHEN doc_id % 13 <> 0 THEN doc_id % 5 WHEN doc_id % 5 = 3 THEN 4 END AS k FROM documents)
 SELECT CASE k WHEN 0 THEN 'py' WHEN 1 THEN 'rs' WHEN 2 THEN 'md' WHEN 3 THEN 'ts' WHEN 4 THEN 'other' ELSE '-' END AS ext, CASE k WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'markdown' WHEN 3 THEN 'typescript' ELSE '-' END AS language, count(*) AS count FROM p GROUP BY 1, 2""",
    "p31_counted": "SELECT o_orderkey AS run FROM orders WHERE o_orderkey % 10 = 0 OR o_totalprice / 5 <= 30000",
    "fmt_methods_section": """WITH fn AS (SELECT DISTINCT 'o' || l_orderkey AS path, 'f' || l_linenumber AS name, l_linenumber * 10 AS line, CAST(l_linenumber * 10 + l_quantity % 9 AS BIGINT) AS e FROM lineitem), cl AS (SELECT 'o' || o_orderkey AS path, 15 + o_orderkey % 40 AS e FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem))
 SELECT cl.path, 'C:' || chr(10) || '  K:15-' || any_value(cl.e) || chr(10) || coalesce(string_agg('    ' || fn.name || ':' || fn.line || chr(10), '' ORDER BY fn.line, fn.name), '') AS text FROM cl LEFT JOIN fn ON fn.path = cl.path AND fn.line >= 15 AND fn.e <= cl.e GROUP BY cl.path""",
}
