"""Tree patterns against a matcher that tries all nodes."""

import itertools
import random

import pytest

from lodestone.operators import trees as T

SOURCE = '''import os, a.b as c
from ..x import y, z as w
@dec(1)
class A(B, metaclass=M):
    """é doc"""
    x: int = 3
    def f(self, a, b: int = 2, *args, k=1, **kw) -> T:
        if a and b or not k:
            return open("f", mode='r').read()[0]
        elif b: pass
        else:
            self.z += g(h(a), lambda q: q + 1)
        for i in [j for j in kw if j]: print(f"{i} é")
        try:
            with open(a) as fh, m: x = y = {1: 2, **kw}
        except E as e: raise
        finally: del x
async def top(): await f(); x = 1 if a < b else -2
def outer(n):
    def inner(): return inner(n, n)
    return inner, open(n), open(n)
'''
QUERIES = [
    "(class_definition name: (identifier) @class body: (block (function_definition name: (identifier) @m)))",
    '((call function: [(identifier) (attribute)] @f arguments: (argument_list . (string) @first)) (#match? @f "^op"))',
    "(function_definition !return_type name: (identifier) @n)",
    "(function_definition name: (identifier) @f >> (call function: (identifier) @g))",
    "(argument_list (_) @a . (_) @b .)",
    '((argument_list (_) @a (_) @b) (#eq? @a @b))',
    '[(call function: (identifier) @x) (attribute attribute: (identifier) @x)] (#any-of? @x "open" "read" "z")',
    "(block (_) @one (return_statement (_)) @two)",
    '(function_definition body: (block . (_) @first) @body) @all (#not-match? @first "^if")',
    "(boolean_operator left: (_) @l right: [(not_operator argument: (_) @no) (identifier) @id])",
    "(_ (identifier) @a (identifier) @b)",
]


def nodes_of(source):
    names = [x.split()[0] for x in T.NODE.split(", ")][1:]
    rows = [dict(zip(names, r, strict=True)) for r in T.numbered(T.python_tree(source), source.encode())]
    for r in rows:
        r["text"] = source.encode()[r["start_byte"] : r["end_byte"]].decode()
        r["children"] = [x for x in rows if x["parent"] == r["pre"]]
    return rows


def by_hand(source, query):
    rows, found = nodes_of(source), []

    def at(p, n):
        """All lists of (capture, node) of a pattern at a node."""
        if p.alternatives:
            return [m + [(c, n) for c in p.captures] for a in p.alternatives for m in at(a, n)]
        if p.kind and n["kind"] != p.kind or any(c["field"] in p.absent for c in n["children"]):
            return []
        out, own = [], [(c, n) for c in p.captures]

        def on(k, before, have):
            if k == len(p.children):
                out.append(have)
                return
            c = p.children[k]
            for x in rows if c.deep else n["children"]:
                if c.deep and n["pre"] not in x["above"] or c.field and x["field"] != c.field or c.first and x["place"] or c.last and not x["is_last"]:
                    continue
                if not c.deep and before is not None and (x["place"] <= before or c.after and x["place"] != before + 1):
                    continue
                for m in at(c, x):
                    on(k + 1, before if c.deep else x["place"], have + m)

        on(0, None, own)
        return out

    def checks(p):
        return [*p.predicates, *(x for c in (*p.children, *p.alternatives) for x in checks(c))]

    import re

    for number, p in enumerate(T.parsed(query)):
        for n in rows:
            for m in at(p, n) if not p.field or n["field"] == p.field else []:
                texts = {c: x["text"] for c, x in m}
                good = True
                for name, first, *more in checks(p):
                    values = [texts.get(v[1:]) if v[:1] == "@" else v for v in more]
                    a = texts.get(first[1:])
                    hit = a is None or (a == values[0] if "eq" in name else bool(re.search(values[0], a)) if "match" in name else a in values)
                    good = good and (a is None or hit != name.startswith("#not"))
                if good:
                    found += [(number, c, x["pre"], x["text"], x["start_line"], x["end_byte"]) for c, x in m]
    return sorted(found)


def got(df):
    return sorted((r["pattern"], r["capture"], r["node"], r["text"], r["start_line"], r["end_byte"]) for r in df.collect())


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("a.py", SOURCE, 1), ("b.py", "def (", 2), ("c.py", None, 3), ("d.py", "", 4), (None, "f(1, 1)\n", 5)], "path string, content string, kind int")


@pytest.mark.parametrize("query", QUERIES)
def test_captures_as_all_nodes_tried(spark, sources, query):
    one = sources.filter("path = 'a.py'")
    want = by_hand(SOURCE, query)
    assert want and got(T.captures(one, query)) == want


def test_random_patterns(spark, sources):
    """Patterns cut out of the tree itself, with some nodes left out, made wild or anchored."""
    rng, rows = random.Random(4), nodes_of(SOURCE)

    def cut(n, depth):
        kind = n["kind"] if rng.random() < 0.8 else "_"
        own = [c for c in n["children"] if rng.random() < 0.6] if depth else []
        inner = "".join(" " + (f"{c['field']}: " if c["field"] and rng.random() < 0.7 else "") + cut(c, depth - 1) for c in own)
        return f"({kind}{inner}) @c{n['pre']}"

    tree = T.trees(sources.filter("path = 'a.py'")).persist()
    for n in rng.sample([r for r in rows if len(r["children"]) > 1], 6):
        query = cut(n, 2)
        assert got(T.matches(tree, query, sources)) == by_hand(SOURCE, query), query
    tree.unpersist()


def test_quantifiers(spark, sources):
    one = sources.filter("path = 'a.py'")
    rows = [(r["capture"], r["text"]) for r in T.captures(one, '(function_definition name: (identifier) @f parameters: (parameters (identifier)* @p)) (#eq? @f "f")').orderBy("node").collect()]
    assert rows == [("f", "f"), ("p", "self"), ("p", "a")]
    assert got(T.captures(one, "(function_definition name: (identifier) @f return_type: (_)? @r)"))[0][1:4:2] == ("f", "f")
    names = {r["text"] for r in T.captures(one, "(function_definition name: (identifier) @f parameters: (parameters (identifier)+))").collect()}
    assert names == {"f", "outer"}


def test_spans_and_order(sources):
    data, rows = SOURCE.encode(), nodes_of(SOURCE)
    assert [r["pre"] for r in rows] == list(range(len(rows))) and sorted(r["post"] for r in rows) == list(range(len(rows)))
    for r in rows:
        for a in r["above"]:
            assert rows[a]["pre"] < r["pre"] and rows[a]["post"] > r["post"]
            assert rows[a]["start_byte"] <= r["start_byte"] and rows[a]["end_byte"] >= r["end_byte"]
        assert r["start_line"] == data[: r["start_byte"]].count(b"\n")
    for kind, texts in {"parameters": ["(self, a, b: int = 2, *args, k=1, **kw)", "()", "(n)", "()"], "argument_list": ["(1)", "(B, metaclass=M)"], "interpolation": ["{i}"]}.items():
        assert [r["text"] for r in rows if r["kind"] == kind][: len(texts)] == texts
    assert {r["kind"] for r in rows} <= T.TREES["python"][1]


@pytest.mark.parametrize("query", ["this !!!", "(foo) @x", "(call", "[]", "(call (#bad? @x))", "", '("=" @x)', '((identifier) @a (#eq? @b "x"))'])
def test_malformed_queries(spark, sources, query):
    with pytest.raises(ValueError):
        T.captures(sources, query)


def test_odd_sources(spark, sources):
    assert {r["path"] for r in T.trees(sources).collect()} == {"a.py", "d.py", None}
    with pytest.raises(ValueError):
        T.trees(sources, "cobol")
    none = spark.createDataFrame([], "path string, content string")
    assert T.captures(none, "(identifier) @x").count() == 0
    long = spark.createDataFrame([("l.py", "x = [" + "f(1), " * 60_000 + "]\n")], "path string, content string")
    assert T.captures(long, "(call function: (identifier) @f)").count() == 60_000
    assert list(itertools.islice(T.numbered(T.python_tree("x"), b"x"), 1))[0][0] == 0
