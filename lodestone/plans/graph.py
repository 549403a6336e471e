"""Graph program: the star schema as a cyclic call graph; suppliers implement nations as traits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.plans.adapters import DEFINITIONS, EDGES, IMPORTS, definitions, edges, imports
from lodestone.session import table

def _place():
    return [F.concat(F.left("caller", F.lit(1)), F.lit(".rs")).alias("path"), F.substring("caller", 2, 20).cast("bigint").alias("line")]


def _calls(s, d):
    """Calls with every third callee in a scope."""
    n = F.substring("callee", 2, 20).cast("bigint")
    scoped = F.when(n % 3 == 0, F.concat(F.lit("Type::"), "callee")).when(n % 3 == 1, F.concat(F.lit("self."), "callee")).otherwise(F.col("callee"))
    return edges(s, d).select("caller", scoped.alias("callee"), *_place())


def _resolved(s, d):
    return G.resolve_callees(_calls(s, d), definitions(s, d))


def _traits(s, d):
    return table(s, d, "supplier").select(F.concat(F.lit("N"), "s_nationkey").alias("trait_name"), F.concat(F.lit("S"), "s_suppkey").alias("impl_type"), F.lit("supplier.rs").alias("path"), F.col("s_suppkey").alias("line"))


def _callers(s, d, impl_only=False):
    return G.caller_edges(edges(s, d).select("caller", "callee", *_place()), None, _traits(s, d), impl_only)


def _out(s, d):
    """Outgoing edges in the order of their neighbours."""
    e = edges(s, d).select(F.col("caller").alias("node"), F.col("callee").alias("neighbor"), *_place())
    return e.withColumn("ord", F.row_number().over(Window.partitionBy("node").orderBy("neighbor")))


def _flat(c):
    return c.select("depth", "node", "neighbor", F.array_join(F.transform("chain", lambda x: x["symbol"]), ">").alias("chain"))


def _structural(s, d):
    defs = definitions(s, d)
    imp = imports(s, d).select(F.concat(F.lit("page"), "page_id").alias("path"), "module")
    return G.structural(defs.filter("kind = 'function'").drop("kind"), defs.filter("kind = 'class'").drop("kind"), imp, edges(s, d).select("caller", "callee", *_place()))


def _links(s, d):
    """Pages import their targets; a target of the form /word is imported by words of its length."""
    i = imports(s, d).select(F.concat(F.lit("p"), "page_id").alias("path"), "module")
    return i.unionByName(i.filter("length(module) < 6").select(F.col("module").alias("path"), F.concat(F.lit("L"), F.length("module").cast("string")).alias("module")).distinct())


_E = f"WITH RECURSIVE {EDGES}, {DEFINITIONS} "
_BFS = "r AS (SELECT '{0}' AS node, 0 AS depth UNION SELECT callee, depth + 1 FROM r JOIN e ON node = caller WHERE depth < {1}), q AS (SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node)"
_CALLERS = "c AS (SELECT callee AS node, caller AS neighbor, false AS is_impl_trait FROM e UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, true FROM supplier)"
_O = "o AS (SELECT caller AS node, callee AS neighbor, row_number() OVER (PARTITION BY caller ORDER BY callee) AS ord FROM e)"

QUERIES = {
    "u1_definitions": lambda s, d: G.all_definitions(definitions(s, d).filter("kind = 'function'"), definitions(s, d).filter("kind = 'class'")),
    "u2_symbols": lambda s, d: G.symbols(definitions(s, d), _callers(s, d), G.callee_edges(edges(s, d).select("caller", "callee", *_place()))).agg(F.count(F.lit(1)).alias("n")),
    "u3_j19_caller_edges": lambda s, d: _callers(s, d).groupBy("node", "is_impl_trait").agg(F.count(F.lit(1)).alias("n")),
    "u4_files_involved": lambda s, d: G.files_involved(G.chains(_out(s, d), "S1", 1), G.chains(_out(s, d), "S2", 1), definitions(s, d)),
    "j2_f2_resolve_callees": lambda s, d: _resolved(s, d).select("caller", "callee"),
    "p9_match_modes": lambda s, d: definitions(s, d).agg(*[F.count_if(G.match(F.col("name"), "p1", m)).alias(m) for m in ("exact", "insensitive", "prefix", "contains")]),
    "p11_impl_only": lambda s, d: _callers(s, d, True).select("node", "neighbor"),
    "w1_first_definitions": lambda s, d: G.first_definitions(definitions(s, d).unionByName(definitions(s, d).withColumn("line", F.col("line") + 7)), ["line", "path"]),
    "a8_unique_callers": lambda s, d: G.unique_callers(_callers(s, d)),
    "a10_o4_frequencies": lambda s, d: G.frequencies(_out(s, d)),
    "j3_w10_reach": lambda s, d: G.reach(_out(s, d), s.createDataFrame([("S1",), ("S2",)], "node string"), 2),
    "g2_j4_chains_outgoing": lambda s, d: _flat(G.chains(_out(s, d), "S1", 1)),
    "g2_chains_incoming": lambda s, d: _flat(G.chains(_out(s, d), "N1", 1, incoming=True)),
    "g4_blast_radius": lambda s, d: G.blast_radius(_out(s, d), "S1", 3),
    "g5_import_closure": lambda s, d: G.import_closure(_links(s, d), "L4", 3),
    "g5_subgraph": lambda s, d: G.blast_radius(_out(s, d), "N1", 2),
    "g6_o9_entries": lambda s, d: G.chain_entries(G.chains(_out(s, d), "S1", 1)),
    "a9_chain_tree": lambda s, d: G.chain_tree(G.chains(_out(s, d), "S1", 1)),
    "p13_test_split": lambda s, d: G.by_test(G.chains(_out(s, d), "S1", 1), F.col("chain")[0]["path"] == "N.rs").groupBy("from_test").count(),
    "g3_j20_u5_structural_edges": lambda s, d: _structural(s, d)[1].groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
    "g3_structural_nodes": lambda s, d: _structural(s, d)[0].groupBy("node_type", "kind").agg(F.count(F.lit(1)).alias("n")),
    "g8_cache_key": lambda s, d: G.cache_key(definitions(s, d).filter("kind = 'class'").select(F.col("name").alias("path"), F.col("line").alias("mtime"))),
}

_CH = f"{_O}, f AS (SELECT node, neighbor FROM o WHERE ord = 1), ch AS (SELECT q.depth, o.node, o.neighbor, o.ord, CASE WHEN q.depth < 1 AND f.neighbor IS NOT NULL THEN o.node || '>' || f.neighbor || '>' || o.neighbor ELSE o.node || '>' || o.neighbor END AS chain, CASE WHEN q.depth < 1 AND f.neighbor IS NOT NULL THEN f.neighbor ELSE o.neighbor END AS second FROM q JOIN o USING (node) LEFT JOIN f ON f.node = o.neighbor)"
_S1 = _E + f", {_BFS.format('S1', 1)}, {_CH} "

ORACLES = {
    "u1_definitions": f"WITH {DEFINITIONS} SELECT * FROM d",
    "u2_symbols": _E + f", {_CALLERS} SELECT count(*) AS n FROM (SELECT name FROM d UNION SELECT node FROM c UNION SELECT caller FROM e)",
    "u3_j19_caller_edges": _E + f", {_CALLERS} SELECT node, is_impl_trait, count(*) AS n FROM c GROUP BY 1, 2",
    "u4_files_involved": _E + f", {_BFS.format('S1', 1)}, q2 AS (SELECT 'S2' AS node UNION SELECT callee FROM e WHERE caller = 'S2'), {_O}, t AS (SELECT node FROM q UNION SELECT node FROM q2), p AS (SELECT left(t.node, 1) || '.rs' AS path FROM t JOIN o USING (node) UNION SELECT left(e2.caller, 1) || '.rs' FROM e e1 JOIN e e2 ON e1.callee = e2.caller WHERE e1.caller IN ('S1', 'S2') UNION SELECT path FROM d) SELECT DISTINCT path FROM p",
    "j2_f2_resolve_callees": _E + "SELECT caller, CASE WHEN callee IN (SELECT name FROM d) THEN callee WHEN CAST(callee[2:] AS BIGINT) % 3 = 0 THEN 'Type::' || callee WHEN CAST(callee[2:] AS BIGINT) % 3 = 1 THEN 'self.' || callee ELSE callee END AS callee FROM e",
    "p9_match_modes": f"WITH {DEFINITIONS} SELECT count_if(name = 'p1') AS exact, count_if(lower(name) = 'p1') AS insensitive, count_if(starts_with(lower(name), 'p1')) AS prefix, count_if(contains(lower(name), 'p1')) AS contains FROM d",
    "p11_impl_only": "SELECT 'N' || s_nationkey AS node, 'S' || s_suppkey AS neighbor FROM supplier",
    "w1_first_definitions": f"WITH {DEFINITIONS} SELECT * FROM d",
    "a8_unique_callers": _E + f", {_CALLERS} SELECT node, count(DISTINCT neighbor) AS callers, count(DISTINCT CASE WHEN is_impl_trait THEN neighbor END) AS impl_callers FROM c GROUP BY node",
    "a10_o4_frequencies": _E + f", {_O} SELECT neighbor AS name, count(*) AS n, arg_min(left(node, 1) || '.rs', ord) AS path FROM o GROUP BY 1 ORDER BY n DESC, name LIMIT 10",
    "j3_w10_reach": _E + ", r AS (SELECT unnest(['S1', 'S2']) AS node, 0 AS depth UNION SELECT callee, depth + 1 FROM r JOIN e ON node = caller WHERE depth < 2) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node",
    "g2_j4_chains_outgoing": _S1 + "SELECT depth, node, neighbor, chain FROM ch",
    "g2_chains_incoming": _E + f", {_BFS.format('N1', 1)}, {_CH} SELECT depth, node, neighbor, array_to_string(list_reverse(string_split(chain, '>')), '>') AS chain FROM ch",
    "g4_blast_radius": _E + f", {_BFS.format('S1', 3)} SELECT node, depth FROM q WHERE depth > 0",
    "g5_import_closure": f"WITH RECURSIVE {IMPORTS}, k AS (SELECT 'p' || page_id AS path, module FROM i UNION ALL SELECT DISTINCT module, 'L' || length(module) FROM i WHERE length(module) < 6), r AS (SELECT 'L4' AS node, 0 AS depth UNION SELECT path, depth + 1 FROM r JOIN k ON node = module WHERE depth < 3) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE depth > 0 GROUP BY node",
    "g5_subgraph": _E + f", {_BFS.format('N1', 2)} SELECT node, depth FROM q WHERE depth > 0",
    "g6_o9_entries": _S1 + "SELECT node AS symbol, left(node, 1) || '.rs' AS file, CAST(node[2:] AS BIGINT) AS line FROM ch ORDER BY depth, node, ord LIMIT 10",
    "a9_chain_tree": _S1 + "SELECT node AS parent, second AS child, count(*) AS n FROM ch GROUP BY 1, 2",
    "p13_test_split": _S1 + "SELECT left(node, 1) = 'N' AS from_test, count(*) AS count FROM ch GROUP BY 1",
    "g3_j20_u5_structural_edges": _E + f", {IMPORTS} SELECT 'contains' AS kind, count(*) AS n FROM d UNION ALL SELECT 'imports', count(*) FROM (SELECT DISTINCT page_id, module FROM i WHERE module <> '') UNION ALL SELECT 'calls', count(*) FROM e WHERE caller IN (SELECT name FROM d) AND callee IN (SELECT name FROM d)",
    "g3_structural_nodes": _E + f", {IMPORTS} SELECT 'symbol' AS node_type, kind, count(*) AS n FROM d GROUP BY kind UNION ALL SELECT 'module', NULL, count(*) FROM (SELECT DISTINCT page_id, module FROM i WHERE module <> '') UNION ALL SELECT 'file', NULL, count(*) FROM (SELECT path FROM d UNION SELECT left(caller, 1) || '.rs' FROM e UNION SELECT 'page' || page_id FROM i)",
    "g8_cache_key": f"WITH {DEFINITIONS}, p AS (SELECT left(sha256(name), 3) AS part, sha256(string_agg(name || ':' || line, chr(10) ORDER BY name)) AS h FROM d WHERE kind = 'class' GROUP BY 1) SELECT sha256(string_agg(h, chr(10) ORDER BY part)) AS key FROM p",
}
