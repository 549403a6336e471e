"""Sites of shadowed names: each language by itself, all names at once, odd sources."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import sites as S
from lodestone.plans.sites import SHAPES, SYMBOL


@pytest.fixture(scope="module")
def found(spark):
    d = spark.createDataFrame([(f"a.{k}", source) for k, (source, _) in SHAPES.items()], "path string, content string")
    return [r.asDict() for r in S.sites(d).collect()]


@pytest.mark.parametrize("kind", list(SHAPES))
def test_shadowed_names(found, kind):
    got = sorted((r["line"], r["column"], r["kind"], r["enclosing_scope"], r["declared_line"] or 0) for r in found if r["path"] == f"a.{kind}" and r["symbol"] == SYMBOL)
    assert got == sorted((line, col, k, scope, own) for k, line, col, scope, own in SHAPES[kind][1])


def test_every_site_is_where_it_says(found):
    text = {f"a.{k}": source.split("\n") for k, (source, _) in SHAPES.items()}
    assert all(text[r["path"]][r["line"] - 1][r["column"] :].startswith(r["symbol"]) for r in found)
    assert len({(r["path"], r["line"], r["column"]) for r in found}) == len(found)


def test_declarations_are_of_the_same_name(found):
    places = {(r["path"], r["symbol"], r["line"]) for r in found}
    assert all((r["path"], r["symbol"], r["declared_line"]) in places for r in found if r["declared_line"])


def test_odd_sources(spark):
    deep = "int f(int x) { " + "{ int x = 1; " * 60 + "use(x); " + "} " * 60 + "return x; }\n"
    long = "void f() {\n" + "  int x = 1; x++;\n" * 5_000 + "}\n"
    rows = [("n.rs", None), ("e.go", ""), ("o.c", "int f() { int x = (1; x"), ("d.c", deep), ("l.java", long), ("p.py", "x = 1"), ("c.ts", "}}) x = 1; )")]
    got = S.sites(spark.createDataFrame(rows, "path string, content string"), ["x"])
    n = {(r["path"], r["kind"]): r["count"] for r in got.groupBy("path", "kind").count().collect()}
    assert n["l.java", "write"] == n["l.java", "write_read"] == 5_000 and n["d.c", "write"] == 60 and n["c.ts", "write"] == 1
    assert not {p for p, _ in n} & {"n.rs", "e.go", "p.py"}
    last = got.filter("path = 'd.c' and kind = 'read'").agg(F.collect_set("declared_line")).first()[0]
    assert last == [1]
    by_line = got.filter("path = 'l.java'").filter("line <> declared_line").count()
    assert by_line == 0


def test_no_symbols(spark):
    d = spark.createDataFrame([("a.c", "int x = 1;")], "path string, content string")
    assert S.sites(d, []).count() == 0 and S.sites(d.filter("false")).count() == 0
