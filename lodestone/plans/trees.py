"""Tree program: patterns over the star schema as trees, and over Python sources made for each part."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import trees as T
from lodestone.session import checkpointed, table


def star_trees(s, d):
    """A tree for each region: nations, their customers (field: market segment), their orders (field: whether urgent, text: status)."""
    n, c, o = (table(s, d, t) for t in ("nation", "customer", "orders"))
    r = table(s, d, "region").select(F.col("r_name").alias("path"), "r_regionkey")
    none = F.lit(None)
    top, nation, buyer, order = F.lit(0).cast("long"), F.col("n_nationkey") + 1, F.col("c_custkey") + 1_000, F.col("o_orderkey") + 1_000_000_000_000

    def rows(df, pre, parent, above, kind, field, text):
        return df.select("path", pre.cast("long").alias("pre"), parent.cast("long").alias("parent"), F.transform(F.array(*above), lambda x: x.cast("long")).alias("above"), F.lit(kind).alias("kind"), field.cast("string").alias("field"), text.cast("string").alias("text"))

    nations = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # regions and nations are fixed in number
    buyers = c.join(F.broadcast(nations), c["c_nationkey"] == nations["n_nationkey"])
    orders = o.join(buyers, o["o_custkey"] == buyers["c_custkey"])
    out = r.select("path", top.alias("pre"), none.cast("long").alias("parent"), F.array().cast("array<bigint>").alias("above"), F.lit("region").alias("kind"), none.cast("string").alias("field"), F.col("path").alias("text"))
    out = out.unionByName(rows(nations, nation, top, [top], "nation", none, F.col("n_name")))
    out = out.unionByName(rows(buyers, buyer, nation, [top, nation], "customer", F.lower("c_mktsegment"), F.col("c_name")))
    out = out.unionByName(rows(orders, order, buyer, [top, nation, buyer], "order", F.when(F.col("o_orderpriority").startswith("1"), "urgent").otherwise("plain"), F.col("o_orderstatus")))
    own, back = Window.partitionBy("path", "parent").orderBy("pre"), Window.partitionBy("path", "parent").orderBy(F.desc("pre"))
    out = out.withColumn("place", (F.row_number().over(own) - 1).cast("int")).withColumn("is_last", F.row_number().over(back) == 1)
    return out.withColumns({k: F.lit(0) for k in ("post", "start_byte", "end_byte", "start_line", "end_line")})


STAR = """
(nation building: (customer . (order) @first urgent: (order) @later .) @buyer (#eq? @first "F") (#match? @later "^[OP]"))
(customer !urgent (order)) @calm
(region >> [(order (_)) (nation)] @land) (#not-any-of? @land "CHINA" "INDIA" "PERU")
((customer urgent: (order) @a . urgent: (order) @b) (#eq? @a @b))
"""

_METHODS = "array_join(transform(sequence(0, p_size % 4), i -> '    def m' || i || '(' || CASE WHEN i = 1 THEN 'cls' ELSE 'self, x' END || '):' || chr(10) || '        return self.g' || (p_partkey + i) || '(f\"{x}\", \"(\", h(\"é\"))'), chr(10))"
_SOURCE = f"CASE p_partkey % 3 WHEN 0 THEN 'def outer():' || chr(10) || '    pass' || chr(10) ELSE '' END || '@dec' || chr(10) || 'class C' || p_partkey || '(Base):' || chr(10) || {_METHODS}"

METHODS = """
(class_definition name: (identifier) @class
  body: (block (function_definition name: (identifier) @method parameters: (parameters . (identifier) @self)
    body: (block (return_statement (call function: (attribute attribute: (identifier) @callee) arguments: (argument_list (_) (string) @text . (_) @last .)))))))
(#eq? @self "self") (#match? @callee "^g[0-9]*[02468]$")
"""


def _python_sources(s, d):
    return table(s, d, "part").select(F.concat(F.lit("p"), "p_partkey", F.lit(".py")).alias("path"), F.expr(_SOURCE).alias("content"))


QUERIES = {
    "e18_x1_tree_patterns": lambda s, d: T.matches(checkpointed(star_trees(s, d)), STAR).select("path", "pattern", "capture", "node", "text"),
    "e18_x1_python_trees": lambda s, d: T.captures(_python_sources(s, d), METHODS).select("path", "capture", "text", "start_line", (F.col("end_byte") - F.col("start_byte")).alias("bytes")),
}

_KINDS = "SELECT r_name AS path, o.*, c_name, c_mktsegment, n_name, o_orderpriority LIKE '1%' AS urgent, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders o JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"

ORACLES = {
    "e18_x1_tree_patterns": f"""WITH o AS ({_KINDS}), e AS (SELECT a.path, a.o_custkey, a.c_name, a.o_orderkey AS x, a.o_orderstatus AS xs, b.o_orderkey AS y, b.o_orderstatus AS ys FROM o a JOIN o b ON a.o_custkey = b.o_custkey
  WHERE a.c_mktsegment = 'BUILDING' AND a.i = 1 AND a.o_orderstatus = 'F' AND b.i > 1 AND b.i = b.n AND b.urgent AND b.o_orderstatus IN ('O', 'P')),
 u AS (SELECT a.path, a.o_orderkey AS x, a.o_orderstatus AS s, b.o_orderkey AS y FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.i = a.i + 1 WHERE a.urgent AND b.urgent AND a.o_orderstatus = b.o_orderstatus)
SELECT path, 0 AS pattern, 'buyer' AS capture, o_custkey + 1000 AS node, c_name AS text FROM e UNION ALL SELECT path, 0, 'first', x + 1000000000000, xs FROM e UNION ALL SELECT path, 0, 'later', y + 1000000000000, ys FROM e
UNION ALL SELECT path, 1, 'calm', o_custkey + 1000, c_name FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM o WHERE urgent)
UNION ALL SELECT r_name, 2, 'land', n_nationkey + 1, n_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_name NOT IN ('CHINA', 'INDIA', 'PERU')
UNION ALL SELECT path, 3, 'a', x + 1000000000000, s FROM u UNION ALL SELECT path, 3, 'b', y + 1000000000000, s FROM u""",
    "e18_x1_python_trees": """WITH m AS (SELECT p_partkey AS k, unnest(range(0, p_size % 4 + 1)) AS i, CASE p_partkey % 3 WHEN 0 THEN 3 ELSE 1 END AS base FROM part), g AS (SELECT *, base + 1 + 2 * i AS line FROM m WHERE i <> 1 AND (k + i) % 2 = 0),
 c AS (SELECT *, unnest(['class', 'method', 'self', 'callee', 'text', 'last']) AS capture FROM g)
SELECT 'p' || k || '.py' AS path, capture, CASE capture WHEN 'class' THEN 'C' || k WHEN 'method' THEN 'm' || i WHEN 'self' THEN 'self' WHEN 'callee' THEN 'g' || (k + i) WHEN 'text' THEN '"("' ELSE 'h("é")' END AS text,
 CAST(CASE capture WHEN 'class' THEN base WHEN 'method' THEN line WHEN 'self' THEN line ELSE line + 1 END AS INTEGER) AS start_line, CAST(CASE capture WHEN 'class' THEN 1 + length(CAST(k AS VARCHAR)) WHEN 'method' THEN 2 WHEN 'self' THEN 4 WHEN 'callee' THEN 1 + length(CAST(k + i AS VARCHAR)) WHEN 'text' THEN 3 ELSE 7 END AS INTEGER) AS bytes FROM c""",
}
