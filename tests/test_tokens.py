"""Token tables: brackets against a stack, calls and functions of each language, odd sources."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import tokens as K
from lodestone.plans.brackets import SHAPES


def test_brackets_as_a_stack_matches_them(spark):
    rng = random.Random(5)
    sources = [("r%d.go" % n, "".join(rng.choice("()()()[]{}a,b; \n") for _ in range(120))) for n in range(12)]

    def by_hand(text):
        rows, stack, pairs, around = K.lexed(text, "go"), [], {}, {}
        for i, (kind, *_) in enumerate(rows):
            if kind == "close":
                if stack:
                    pairs[stack.pop()] = i
                else:
                    return None  # closes what never opened: only balanced prefixes are compared
            around[i] = stack[-1] if stack else None
            if kind == "open":
                stack.append(i)
        return pairs | {i: 2**31 - 1 for i in stack}, around

    good = [(p, t[: next((k for k in range(len(t), 0, -1) if by_hand(t[:k])), 0)]) for p, t in sources]
    t = K.inside_of(K.nested(K.tokens(spark.createDataFrame(good, "path string, content string")))).persist()
    pairs = K.pairs_of(t)
    found = {(r["path"], r["own_depth"], r["own_pair"]): r["start"] for r in pairs.collect()}
    for path, text in good:
        want, around = by_hand(text)
        assert {r["start"]: r["end"] for r in pairs.filter(F.col("path") == path).collect()} == want
        got = {r["i"]: found.get((path, r["depth"] - 1, r["around"])) for r in t.filter(F.col("path") == path).collect()}
        assert {i: around[i] for i in around} == got
    t.unpersist()


def test_calls_and_functions_of_all_languages(spark):
    d = spark.createDataFrame([(f"a.{k}", source.replace("{k}", "9")) for k, (source, *_) in SHAPES.items()], "path string, content string")
    calls = K.calls(d).collect()
    assert sorted((r["path"], r["caller"], r["callee"], r["line"], r["arg_count"]) for r in calls) == sorted((f"a.{k}", a.replace("{k}", "9"), b.replace("{k}", "9"), *c) for k, (_, own, _) in SHAPES.items() for a, b, *c in own)
    text = {f"a.{k}": source.replace("{k}", "9").split("\n") for k, (source, *_) in SHAPES.items()}
    assert all(text[r["path"]][r["line"] - 1][r["column"] :].startswith(r["callee"]) for r in calls)
    assert sorted(map(tuple, K.functions(d).collect())) == sorted((f"a.{k}", n.replace("{k}", "9"), *c) for k, (*_, own) in SHAPES.items() for n, *c in own)


def test_type_references(spark):
    d = spark.createDataFrame([("a.rs", "struct S { x: Map<K, V>, y: u8 }\nimpl Show for S { fn f(a: &T) -> R { a.b() } }\n"), ("b.java", "class A extends B {\n  List<C> m(D d) throws E { return new F(g); }\n}\n"), ("c.ts", "interface I extends J { x: K; y: number }\nconst a = b as L;\n"), ("d.cpp", "class A { Foo f; Bar* b; };\n"), ("e.go", "type S struct { a Thing }\nfunc f(x Other) {}\n")], "path string, content string")
    got = {}
    for r in K.references(d).collect():
        got.setdefault(r["path"], set()).add((r["symbol"], r["line"]))
    assert got["a.rs"] == {("S", 1), ("Map", 1), ("K", 1), ("V", 1), ("Show", 2), ("T", 2), ("R", 2)}
    assert got["b.java"] == {("A", 1), ("B", 1), ("List", 2), ("C", 2), ("D", 2), ("E", 2), ("F", 2)}
    assert got["c.ts"] == {("I", 1), ("J", 1), ("K", 1), ("L", 2)}
    assert got["d.cpp"] == {("A", 1), ("Foo", 1), ("Bar", 1)}
    assert got["e.go"] == {("S", 1), ("Thing", 1), ("Other", 2)}


def test_odd_sources(spark):
    rows = [("n.rs", None, "n"), ("e.go", "", "e"), ("u.java", "class A { void m() { f(1, (2", "u"), ("x.c", ")))}}} g(1);", "x"), ("p.py", "f(1)", "p"), ("q.ts", 'f("never closed', "q"), ("l.c", "int main(void) { " + "f(g(1), 2); " * 20_000 + "}", "l")]
    d = spark.createDataFrame(rows, "path string, content string, kind string")
    got = {}
    for r in K.calls(d).groupBy("path", "caller", "callee", "arg_count").count().collect():
        got[r["path"], r["caller"], r["callee"], r["arg_count"]] = r["count"]
    assert got["l.c", "main", "f", 2] == got["l.c", "main", "g", 1] == 20_000
    assert got["u.java", "m", "f", 2] == 1 and got["q.ts", "<module>", "f", 1] == 1
    assert not any(k[0] in ("n.rs", "e.go", "p.py") for k in got)


def test_functions_without_a_result_and_names_behind_numbers(spark):
    rows = [("a.c", "void g(void) { h(); }\nvoid k(int a);\n"), ("b.java", "abstract class A { abstract void m(int x); void n() { m(1); } }"), ("c.rs", "fn f() { for i in 0..n() { 1.max(g(2.5)); } }")]
    got = {(r["path"], r["caller"], r["callee"]) for r in K.calls(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == {("a.c", "g", "h"), ("b.java", "n", "m"), ("c.rs", "f", "n"), ("c.rs", "f", "max"), ("c.rs", "f", "g")}


@pytest.mark.parametrize("text", ['"a\\"(" f(1)', "// f(\nf(1)", "/* f( */ f(1)", "'(' f(1)"])
def test_strings_and_comments_hold_no_brackets(text):
    assert [t for k, t, *_ in K.lexed(text, "java") if k in ("open", "close")] == ["(", ")"]
