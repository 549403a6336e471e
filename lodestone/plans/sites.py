"""Definition and use sites: a source for each part, in one of six languages, in which a name is shadowed, and where it is read, written and declared.

The part's size moves everything down by up to three lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import sites as S
from lodestone.session import spread_rows, table

SYMBOL = "x"
# Each language: source, and the sites of the symbol (kind, line, column, enclosing function, line of the declaration or 0).
SHAPES: dict[str, tuple[str, list[tuple[str, int, int, str, int]]]] = {
    "rs": (
        "fn f(x: i32) -> i32 {\n    let y = x + 1;\n    let x = x * 2;\n    {\n        let mut x = x;\n        x += 1;\n        p.x = x;\n    }\n    let g = |x| x + y;\n    for x in 0..x { use_it(x); }\n    x = g(x); S { x: x };\n    x\n}\nfn h() { x(); }\n",
        [("read", 1, 5, "f", 1), ("read", 2, 12, "f", 1), ("write", 3, 8, "f", 3), ("read", 3, 12, "f", 1), ("write", 5, 16, "f", 5), ("read", 5, 20, "f", 3), ("write_read", 6, 8, "f", 5), ("read", 7, 14, "f", 5), ("read", 9, 13, "f", 9), ("read", 9, 16, "f", 9)]
        + [("read", 10, 8, "f", 10), ("read", 10, 16, "f", 3), ("read", 10, 27, "f", 10), ("write", 11, 4, "f", 3), ("read", 11, 10, "f", 3), ("read", 11, 21, "f", 3), ("read", 12, 4, "f", 3), ("read", 14, 9, "h", 0)],
    ),
    "go": (
        "package p\nvar x = 1\nfunc f(x int, y string) (int, error) {\n\t{ x, z := x+1, g(x)\n\t_ = x }\n\tif x := z; x > 0 {\n\t\tx++\n\t\ts.x = x\n\t} else { x = 2 }\n\tfor i, x := range xs { use(i, x) }\n\th := func(x int) int { return x }\n\tx += h(x)\n\treturn x, nil\n}\nfunc k() { x = 3 }\n",
        [("write", 2, 4, "<module>", 2), ("read", 3, 7, "f", 3), ("write", 4, 3, "f", 4), ("read", 4, 11, "f", 3), ("read", 4, 18, "f", 3), ("read", 5, 5, "f", 4), ("write", 6, 4, "f", 6), ("read", 6, 12, "f", 6), ("write_read", 7, 2, "f", 6), ("read", 8, 8, "f", 6), ("write", 9, 10, "f", 3)]
        + [("read", 10, 8, "f", 10), ("read", 10, 31, "f", 10), ("read", 11, 11, "f", 11), ("read", 11, 31, "f", 11), ("write", 12, 1, "f", 3), ("read", 12, 8, "f", 3), ("read", 13, 8, "f", 3), ("write", 15, 11, "k", 2)],
    ),
    "java": (
        'class A {\n  int x = 0;\n  int f(int x) {\n    int y = x, z = this.x;\n    for (int i = 0, n = x; i < n; i++) { x -= i; }\n    Runnable r = () -> { String x = "a"; use(x); };\n    g((x, q) -> x + q, x); h(x -> x, x);\n    x++;\n    return x;\n  }\n  void k() { x = 2; }\n}\n',
        [("read", 2, 6, "<module>", 2), ("read", 3, 12, "f", 3), ("read", 4, 12, "f", 3), ("read", 4, 24, "f", 0), ("read", 5, 24, "f", 3), ("write", 5, 41, "f", 3), ("write", 6, 32, "f", 6), ("read", 6, 45, "f", 6), ("read", 7, 7, "f", 7), ("read", 7, 16, "f", 7), ("read", 7, 23, "f", 3)]
        + [("read", 7, 29, "f", 7), ("read", 7, 34, "f", 7), ("read", 7, 37, "f", 3), ("write_read", 8, 4, "f", 3), ("read", 9, 11, "f", 3), ("write", 11, 13, "k", 2)],
    ),
    "ts": (
        "const x = 1;\nfunction f(x: number, y = x) {\n  const { a, b: z } = g(x);\n  for (const x of xs) { use(x); }\n  const h = (x: number) => x + 1, k = x => x * 2;\n  if (y) { let x = { x: a, y: x }; o.x = x; }\n  x += h(x);\n  return x;\n}\nclass C { x = 2; m(x: string) { return this.x + x; } }\nx++;\n",
        [("write", 1, 6, "<module>", 1), ("read", 2, 11, "f", 2), ("read", 2, 26, "f", 2), ("read", 3, 24, "f", 2), ("read", 4, 13, "f", 4), ("read", 4, 28, "f", 4), ("read", 5, 13, "f", 5), ("read", 5, 27, "f", 5), ("read", 5, 38, "f", 5), ("read", 5, 43, "f", 5), ("write", 6, 15, "f", 6)]
        + [("read", 6, 30, "f", 6), ("read", 6, 41, "f", 6), ("write_read", 7, 2, "f", 2), ("read", 7, 9, "f", 2), ("read", 8, 9, "f", 2), ("write", 10, 10, "<module>", 0), ("read", 10, 19, "m", 10), ("read", 10, 48, "m", 10), ("write_read", 11, 0, "<module>", 1)],
    ),
    "c": (
        "static int x = 1;\nint f(int x, char *s)\n{\n  int *p = &x;\n  { int x = 2; x++; s->x = x; }\n  for (int x = 0; x < 3; ++x) use(x);\n  while (x) { T x; x = 1; }\n  x += *p * x;\n  return x;\n}\nvoid g(void) { x = 3; }\n",
        [("write", 1, 11, "<module>", 1), ("read", 2, 10, "f", 2), ("read", 4, 12, "f", 2), ("write", 5, 8, "f", 5), ("write_read", 5, 15, "f", 5), ("read", 5, 27, "f", 5), ("write", 6, 11, "f", 6), ("read", 6, 18, "f", 6), ("write_read", 6, 27, "f", 6), ("read", 6, 34, "f", 6)]
        + [("read", 7, 9, "f", 2), ("read", 7, 16, "f", 7), ("write", 7, 19, "f", 7), ("write", 8, 2, "f", 2), ("read", 8, 12, "f", 2), ("read", 9, 9, "f", 2), ("write", 11, 15, "g", 1)],
    ),
    "cpp": (
        "namespace n { struct S { int x; int get() const { return x; } }; }\nint f(int x) {\n  auto l = [&](int x) { return x; };\n  for (auto x : xs) { use(x); }\n  if (int x = g(); x > 0) { x *= 2; }\n  try { h(); } catch (E &x) { log(x); }\n  n::x = x; x--;\n  return x * x;\n}\n",
        [("read", 1, 57, "get", 1), ("read", 2, 10, "f", 2), ("read", 3, 19, "f", 3), ("read", 3, 31, "f", 3), ("read", 4, 12, "f", 4), ("read", 4, 26, "f", 4), ("write", 5, 10, "f", 5), ("read", 5, 19, "f", 5), ("write", 5, 28, "f", 5)]
        + [("read", 6, 25, "f", 6), ("read", 6, 34, "f", 6), ("read", 7, 5, "f", 0), ("read", 7, 9, "f", 2), ("write_read", 7, 12, "f", 2), ("read", 8, 9, "f", 2), ("read", 8, 13, "f", 2)],
    ),
}


def _pick(at):
    return F.element_at(F.array(*[F.lit(v) for v in at]), (F.col("p_partkey") % len(SHAPES) + 1).cast("int"))


def _parts(s, d):
    return table(s, d, "part").select(F.concat(F.lit("u"), "p_partkey", F.lit("."), _pick(SHAPES)).alias("path"), "p_partkey", "p_size")


def _sources(parts):
    """Keys are shuffled, the sources are made behind that."""
    return parts.select("path", F.concat(F.repeat(F.lit("\n"), F.col("p_size") % 4), _pick([v for v, _ in SHAPES.values()])).alias("content"))


_SITES = ", ".join(f"({n}, '{k}', {line}, {col}, '{scope}', {own})" for n, (_, rows) in enumerate(SHAPES.values()) for k, line, col, scope, own in rows)
_EXT = "['" + "', '".join(SHAPES) + "']"
_FROM = f"FROM (SELECT 'u' || p_partkey || '.' || {_EXT}[p_partkey % {len(SHAPES)} + 1] AS path, kind, CAST(line + p_size % 4 AS INTEGER) AS line, CAST(col AS INTEGER) AS col, scope, CAST(CASE WHEN own > 0 THEN own + p_size % 4 END AS INTEGER) AS own FROM part JOIN (VALUES {_SITES}) v(shape, kind, line, col, scope, own) ON shape = p_partkey % {len(SHAPES)})"

QUERIES = {
    "e9_bound_sites": lambda s, d: S.sites(_sources(spread_rows(_parts(s, d), "p_partkey")), [SYMBOL], spread=False),
    "p16_j11_def_use": lambda s, d: S.def_use(_sources(S.by_path(_parts(s, d))), SYMBOL, ranged=True).select("ord", "path", "kind", "line", "column"),
}

ORACLES = {
    "e9_bound_sites": f"SELECT path, kind, '{SYMBOL}' AS symbol, line, col AS \"column\", scope AS enclosing_scope, own AS declared_line {_FROM}",
    "p16_j11_def_use": f"SELECT row_number() OVER (ORDER BY kind = 'read', path, line, col) AS ord, path, kind, line, col AS \"column\" {_FROM}",
}
