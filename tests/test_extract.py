"""Extractors: exact for Python, declarations for the other languages."""

import pytest

from lodestone.operators import extract as E

RUST = """use std::collections::HashMap;
use std::{fmt, io::{self, Read}};

/// fn not_this() {}
struct Point { x: i32 }

impl Point {
    fn new(x: i32) -> Self { Point { x } }
    fn area(&self, k: i32) -> i32 { helper(self.x, k) }
}

impl fmt::Display for Point { }
impl Write for Point { fn go(&self) {} }

fn helper(a: i32, b: i32) -> i32 { let mut total = a; total += b; total }
"""
PYTHON = """import os
import sys
from typing import List, Optional


def greet(name: str) -> str:
    return "hi " + name


def main():
    total = 0
    total += len(greet("x"))
    print(total)


class Greeter(Base):
    size = 1

    def run(self, n: Optional[int] = None) -> List[str]:
        return [greet("a")]
"""


def kinds(rows, kind):
    return [r for r in rows if r[0] == kind]


def test_python_is_exact():
    rows = E.python_rows(PYTHON)
    assert [(r[1], r[2], r[3], r[5]) for r in kinds(rows, "function")] == [("greet", 6, 7, None), ("main", 10, 13, None), ("run", 19, 20, "Greeter")]
    assert [(r[1], r[8]) for r in kinds(rows, "class")] == [("Greeter", ["Base"])]
    assert [(r[1], r[8]) for r in kinds(rows, "import")] == [("os", []), ("sys", []), ("typing", ["List", "Optional"])]
    assert [(r[1], r[5], r[9]) for r in kinds(rows, "call")] == [("len", "main", 1), ("greet", "main", 1), ("print", "main", 1), ("greet", "run", 1)]
    assert [(r[2], r[10]) for r in kinds(rows, "site") if r[1] == "total"] == [(11, "write"), (12, "write_read"), (13, "read")]


def test_rust_declarations():
    rows = E.brace_rows(RUST, "rust")
    assert [(r[1], r[5]) for r in kinds(rows, "function")] == [("new", "Point"), ("area", "Point"), ("go", "Point"), ("helper", None)]
    assert [r[1] for r in kinds(rows, "class")] == ["Point"]
    assert [(r[1], r[5]) for r in kinds(rows, "impl_trait")] == [("Write", "Point")]
    assert ("std::collections", ["HashMap"]) in [(r[1], r[8]) for r in kinds(rows, "import")]
    assert [(r[1], r[5], r[9]) for r in kinds(rows, "call")] == [("helper", "area", 2)]


@pytest.mark.parametrize(
    ("language", "source", "functions", "classes"),
    [
        ("go", 'package a\nimport "fmt"\ntype T struct { x int }\nfunc (t T) Run(a int) error { return nil }\nfunc main() { fmt.Println(1) }\n', ["Run", "main"], ["T"]),
        ("java", "import java.util.List;\npublic class A extends B implements C {\n  private int f(int x) { return g(x); }\n  int g(int y) { return y; }\n}\n", ["f", "g"], ["A"]),
        ("typescript", "import { a } from './a';\ninterface I { x: number }\nclass K extends J {\n  run(n: number): string { return f(n); }\n}\nfunction f(n: number): string { return ''; }\nconst g = (x) => x;\n", ["run", "f", "g"], ["I", "K"]),
        ("csharp", "using System;\npublic class A : B {\n  public int F(int x) { return x; }\n}\n", ["F"], ["A"]),
        ("kotlin", "import a.b\nclass A : B() {\n  fun f(x: Int): Int { return x }\n}\n", ["f"], ["A"]),
        ("cpp", "#include <vector>\nclass A : public B { int x; };\nint add(int a, int b) { return a + b; }\n", ["add"], ["A"]),
        ("markdown", "# One\n```\n# no\n```\n## Two\n", [], ["One", "Two"]),
    ],
)
def test_other_languages(language, source, functions, classes):
    rows = E.rows_of(source, language)
    assert [r[1] for r in kinds(rows, "function")] == functions
    assert [r[1] for r in kinds(rows, "class")] == classes


def test_fortran_module_is_no_class():
    rows = E.fortran_rows("module m\n use iso\ncontains\n subroutine s(a)\n  call t(a)\n end subroutine s\n real function f(x)\n end function f\nend module m\n")
    assert sorted(r[1] for r in kinds(rows, "function")) == ["f", "s"] and not kinds(rows, "class")
    assert [(r[1], r[5]) for r in kinds(rows, "call")] == [("t", "s")]


def test_astro_empty_and_broken():
    assert [r[1] for r in E.rows_of("---\nimport X from './x';\n---\n<p/>", "astro")] and E.rows_of("<p/>", "astro") == []
    assert E.rows_of("", "python") == []
    assert E.rows_of("def (", "python")[0][0] == "error"
    assert E.exports("__all__ = ['a']\ndef b(): pass") == ["a"] and E.exports("def b(): pass\ndef _c(): pass\nclass D: pass") == ["b", "D"]


def test_tables(spark):
    src = spark.createDataFrame([("a/m.py", PYTHON), ("p.rs", RUST), ("a/w.py", "from .m import *\nfrom .w import *\n"), ("empty.py", ""), ("x.bin", "?")], "path string, content string")
    x = E.extract(src).persist()
    assert {(r.path, r.function_count, r.class_count) for r in E.counts(x).collect()} >= {("a/m.py", 3, 1), ("p.rs", 4, 1)}
    assert {(r.callee, r.n) for r in E.call_frequency(x).filter("path = 'a/m.py'").collect()} == {("greet", 2), ("len", 1), ("print", 1)}
    assert [(r.kind, r.line) for r in E.def_use(x, "total").filter("path = 'a/m.py'").orderBy("ord").collect()] == [("write", 11), ("write_read", 12), ("read", 13)]
    assert {r.name for r in E.impl_methods(x).filter("path = 'p.rs'").collect()} == {"new", "area", "go"}
    w = {r.module: r["items"] for r in E.wildcard_imports(x, src).filter("path = 'a/w.py'").collect()}
    assert w == {".m": ["greet", "main", "Greeter"], ".w": ["*"]}
    assert E.module_index(x).filter("path = 'a/m.py'").first().functions[0].name == "greet"
    assert E.references(x).filter("path = 'a/m.py' and symbol = 'Optional'").count() == 1
    assert E.impl_traits(x).first().impl_type == "Point"


def test_query_captures(spark):
    E.register(spark)
    spark.createDataFrame([("p", "fn a\nfn b")], "path string, content string").createOrReplaceTempView("src_q")
    got = spark.sql("SELECT c.* FROM src_q s, LATERAL query_captures(s.content, 'fn (?P<name>[a-z])') c")
    assert [(r.capture, r.text, r.line) for r in got.collect()] == [("name", "a", 1), ("name", "b", 2)]


def test_registered_language(spark):
    E.register_language("ini", lambda source: [E.row("class", line[1:-1], k) for k, line in enumerate(source.split("\n"), 1) if line.startswith("[")])
    try:
        got = E.extract(spark.createDataFrame([("a.ini", "[x]\nk = 1\n[y]")], "path string, content string")).collect()
        assert [(r.kind, r.name, r.line) for r in got] == [("class", "x", 1), ("class", "y", 3)]
    finally:
        del E.READERS["ini"]


def test_report_lets_go_of_its_scan(spark):
    from lodestone.operators import telemetry
    from lodestone.plans.adapters import metric_events

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    with telemetry.report(metric_events(spark, "/root/testdata/sf0.001")) as sections:
        assert sections and all(df.columns for df in sections.values())
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_kinds_asked_for_are_all_that_is_read(spark, monkeypatch):
    from lodestone.plans.languages import SHAPES

    sources = [(f"p{k}.{ext}", code) for ext, shapes in SHAPES.values() for k, (code, _) in enumerate(shapes)] + [("bad.py", "def (:"), ("none.rs", None)]
    df = spark.createDataFrame(sources, "path string, content string")
    every = [tuple(r) for r in E.extract(df).collect()]
    for kinds in (("function", "class", "import"), ("site",), ("impl_trait", "call"), ("reference",)):
        got = [tuple(r) for r in E.extract(df, *kinds).collect()]
        assert sorted(map(repr, got)) == sorted(repr(r) for r in every if r[1] in (*kinds, "error")) and any(r[1] == "error" for r in got)
    monkeypatch.setattr(E, "_NAME", None)
    assert {r[0] for r in E.rows_of("fn f(a: B) { g(a) }", "rust", kinds=frozenset({"function"}))} == {"function"}
    own = lambda s: [E.row("site", s, 1), E.row("class", s, 2)]
    assert [r[0] for r in E.rows_of("x", "rust", {"rust": own}, frozenset({"class"}))] == ["class"]
