"""Extraction program: small Python and Rust sources made from the part table, read by the extractors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import extract as E
from lodestone.session import spread_rows, table

_PY = """'import os' || chr(10) || 'from m' || p_size || ' import a, b' || chr(10) || chr(10) || 'def f' || p_partkey || '(x, y: int) -> T' || p_size || ':' || chr(10) || '    total = g' || p_size || '(x, y)' || chr(10) || '    total += 1' || chr(10) || '    return total' || chr(10) || chr(10) || 'class C' || p_partkey || '(Base, m.Other):' || chr(10) || '    def run(self):' || chr(10) || '        return f' || p_partkey || '(1, 2)'"""
_RS = """'use std::io;' || chr(10) || 'struct S' || p_partkey || ' { x: i32 }' || chr(10) || 'impl Show for S' || p_partkey || ' {' || chr(10) || '    fn show(&self) -> i32 { help(self.x, ' || p_size || ') }' || chr(10) || '}' || chr(10) || 'fn help(a: i32, b: i32) -> i32 { a + b }'"""


def parts(s, d):
    """Keys and sizes over all tasks, so that sources, which are many times as large, are made where they are read."""
    return spread_rows(table(s, d, "part").select("p_partkey", "p_size"), "p_partkey")


def _python(s, d, *kinds):
    return E.extract(parts(s, d).select(F.concat(F.lit("p"), "p_partkey", F.lit(".py")).alias("path"), F.expr(_PY).alias("content")), *kinds, spread=False)


def _rust(s, d, *kinds):
    return E.extract(parts(s, d).select(F.concat(F.lit("p"), "p_partkey", F.lit(".rs")).alias("path"), F.expr(_RS).alias("content")), *kinds, spread=False)


def _captures(s, d):
    E.register(s)
    table(s, d, "part").select("p_partkey", F.expr(_RS).alias("content")).createOrReplaceTempView("lodestone_rust_parts")
    return s.sql("SELECT p.p_partkey, c.text, c.line FROM lodestone_rust_parts p, LATERAL query_captures(p.content, 'fn (?P<name>[a-z]+)') c")


def _wildcards(s, d):
    p = table(s, d, "part")
    own = p.select(F.concat(F.lit("d/m"), "p_partkey", F.lit(".py")).alias("path"), F.expr("'def f' || p_partkey || '(): pass' || chr(10) || 'def _g(): pass'").alias("content"))
    users = p.select(F.concat(F.lit("d/u"), "p_partkey", F.lit(".py")).alias("path"), F.expr("'from .m' || p_partkey || ' import *'").alias("content"))
    src = own.unionByName(users)
    return E.wildcard_imports(E.extract(src, "import"), src).select("path", "module", F.array_join("items", ",").alias("items"))


QUERIES = {
    "e2_e3_functions": lambda s, d: E.functions(_python(s, d, "function")),
    "e3_classes": lambda s, d: E.classes(_python(s, d, "class")).select("path", "name", "line", "end_line", F.array_join("inherits", ",").alias("inherits")),
    "e4_calls": lambda s, d: E.calls(_python(s, d, "call")).select("path", "caller", "callee", "line", "arg_count"),
    "e5_imports": lambda s, d: E.imports(_python(s, d, "import")).select("path", "module", F.array_join("items", ",").alias("items"), "line"),
    "e6_j5_impl_methods": lambda s, d: E.impl_methods(_rust(s, d, "function", "class")).select("path", "class", "name", "line", "class_line"),
    "e7_w2_references": lambda s, d: E.references(_python(s, d, "reference")).select("path", "symbol", "line"),
    "e8_impl_traits": lambda s, d: E.impl_traits(_rust(s, d, "impl_trait")),
    "e9_o8_def_use": lambda s, d: E.def_use(_python(s, d, "site"), "total").select("path", "kind", "line", "enclosing_scope"),
    "e15_module_index": lambda s, d: E.module_index(_python(s, d, "function", "import")).select("path", F.array_join(F.transform("functions", lambda f: f["name"]), ",").alias("functions"), F.array_join(F.transform("imports", lambda f: f["module"]), ",").alias("imports")),
    "e16_j12_wildcards": _wildcards,
    "e18_x1_captures": _captures,
    "a6_e1_counts": lambda s, d: E.counts(_rust(s, d, "function", "class")),
    "a7_call_frequency": lambda s, d: E.call_frequency(_rust(s, d, "call")),
}

_P = "'p' || p_partkey || '.py' AS path"
_R = "'p' || p_partkey || '.rs' AS path"

ORACLES = {
    "e2_e3_functions": f"SELECT {_P}, 'f' || p_partkey AS name, 4 AS line, 7 AS end_line, NULL AS class, 'x, y: int' AS params, 'T' || p_size AS return_type FROM part UNION ALL SELECT {_P}, 'run', 10, 11, 'C' || p_partkey, 'self', NULL FROM part",
    "e3_classes": f"SELECT {_P}, 'C' || p_partkey AS name, 9 AS line, 11 AS end_line, 'Base,m.Other' AS inherits FROM part",
    "e4_calls": f"SELECT {_P}, 'f' || p_partkey AS caller, 'g' || p_size AS callee, 5 AS line, 2 AS arg_count FROM part UNION ALL SELECT {_P}, 'run', 'f' || p_partkey, 11, 2 FROM part",
    "e5_imports": f"SELECT {_P}, 'os' AS module, '' AS items, 1 AS line FROM part UNION ALL SELECT {_P}, 'm' || p_size, 'a,b', 2 FROM part",
    "e6_j5_impl_methods": f"SELECT {_R}, 'S' || p_partkey AS class, 'show' AS name, 4 AS line, 2 AS class_line FROM part",
    "e7_w2_references": f"SELECT {_P}, 'int' AS symbol, 4 AS line FROM part UNION ALL SELECT {_P}, 'T' || p_size, 4 FROM part",
    "e8_impl_traits": f"SELECT {_R}, 'Show' AS trait_name, 'S' || p_partkey AS impl_type, 3 AS line FROM part",
    "e9_o8_def_use": f"SELECT {_P}, unnest(['write', 'write_read', 'read']) AS kind, unnest([5, 6, 7]) AS line, 'f' || p_partkey AS enclosing_scope FROM part",
    "e15_module_index": f"SELECT {_P}, 'f' || p_partkey || ',run' AS functions, 'os,m' || p_size AS imports FROM part",
    "e16_j12_wildcards": "SELECT 'd/u' || p_partkey || '.py' AS path, '.m' || p_partkey AS module, 'f' || p_partkey AS items FROM part",
    "e18_x1_captures": "SELECT p_partkey, unnest(['show', 'help']) AS text, unnest([4, 6]) AS line FROM part",
    "a6_e1_counts": f"SELECT {_R}, CAST(2 AS BIGINT) AS function_count, CAST(1 AS BIGINT) AS class_count FROM part",
    "a7_call_frequency": f"SELECT {_R}, 'help' AS callee, CAST(1 AS BIGINT) AS n FROM part",
}
