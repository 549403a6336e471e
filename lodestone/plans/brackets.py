"""Calls of languages with brackets: a source for each part, in one of seven languages, and the calls that are in it.

The part's key goes into names, its size moves everything down by up to three lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import tokens as K
from lodestone.session import spread_rows, table

# Each language: source, and its calls (caller, callee, line, arguments) and functions with a body (name, line, end line).
SHAPES: dict[str, tuple[str, list[tuple[str, str, int, int]], list[tuple[str, int, int]]]] = {
    "rs": (
        'use std::fmt;\nstruct P<T> { x: Vec<T> }\nimpl<T: Clone> Show for P<T> {\n    fn show{k}(&self, n: i32) -> Option<Box<T>> where T: Copy {\n        let s = "f(x) {"; // g(1)\n        let c = |a, b| add{k}(a, b);\n        self.x.iter().map(|y, z| mul(y, (z, 1))).fold(0, sum,);\n        println!("{}", hidden(1));\n'
        "        match n { Some(k) if ok(k) => go(k), Ok(Err(e)) => std::mem::drop(e), _ => None }\n        if let Some(q) = find(n, [1, 2]) { inner(q); }\n        fn nested(a: u8) { deep('{', b\"(\") }\n        x.collect::<Vec<_>>()\n    }\n}\nfn main() { run{k}() }\n",
        [("show{k}", "add{k}", 6, 2), ("show{k}", "iter", 7, 0), ("show{k}", "map", 7, 1), ("show{k}", "mul", 7, 2), ("show{k}", "fold", 7, 2), ("show{k}", "ok", 9, 1), ("show{k}", "go", 9, 1), ("show{k}", "drop", 9, 1), ("show{k}", "find", 10, 2), ("show{k}", "inner", 10, 1), ("nested", "deep", 11, 2), ("main", "run{k}", 15, 0)],
        [("show{k}", 4, 13), ("nested", 11, 11), ("main", 15, 15)],
    ),
    "go": (
        'package p\ntype S struct { a int }\ntype I interface { Do(x int) string }\nfunc (s *S) M{k}(a int, f func(int) error) (int, error) {\n\tgo func() { work(a, `x(`, "y)") }()\n\tdefer s.close{k}()\n\tif v, ok := s.m["k"]; ok { return conv(v), nil }\n\treturn fmt.Sprint(a, f(1, g(2))), nil\n}\nfunc G[T any](x T) T { return id(x) }\n',
        [("M{k}", "work", 5, 3), ("M{k}", "close{k}", 6, 0), ("M{k}", "conv", 7, 1), ("M{k}", "Sprint", 8, 2), ("M{k}", "f", 8, 2), ("M{k}", "g", 8, 1), ("G", "id", 10, 1)],
        [("M{k}", 4, 9), ("G", 10, 10)],
    ),
    "java": (
        "import a.B;\n@Ann(value = 1)\npublic class A<T> extends B implements C {\n  enum E { RED(1), GREEN(2); E(int v) { set(v); } }\n  A(int x) { super(x); init{k}(x, new D(y(1)), \"a, b(\", 'c'); }\n  abstract int q(int a);\n  public <R> List<R> m{k}(Map<String, R> a, int... b) throws X {\n    for (int i = 0; i < n(); i++) { a.get(i).put(f(1, 2), List.of()); }\n    Runnable r = () -> call(this::x, (p, q) -> add(p, q));\n    return Foo.<R>bar(a);\n  }\n}\n",
        [("E", "set", 4, 1), ("A", "init{k}", 5, 4), ("A", "y", 5, 1), ("m{k}", "n", 8, 0), ("m{k}", "get", 8, 1), ("m{k}", "put", 8, 2), ("m{k}", "f", 8, 2), ("m{k}", "of", 8, 0), ("m{k}", "call", 9, 2), ("m{k}", "add", 9, 2), ("m{k}", "bar", 10, 1)],
        [("E", 4, 4), ("A", 5, 5), ("m{k}", 7, 11)],
    ),
    "ts": (
        "import { x } from './y';\nclass A<T> extends B {\n  private p: Map<string, T> = make{k}(1);\n  constructor(a: X) { super(a); }\n  async m{k}(a: string,\n    b = dflt(1)): Promise<T> {\n    const g = (x: number) => h(x, { y: [1, 2] });\n    return c ? f(1) : g(2); }\n  get v(): number { return this.q?.r(`t${1}(`).s(); }\n}\ninterface I { m(x: number): void; }\nfunction* gen<T>(x: T) { yield use(x, new Z(k(1))); }\n",
        [("<module>", "make{k}", 3, 1), ("m{k}", "dflt", 6, 1), ("m{k}", "h", 7, 2), ("m{k}", "f", 8, 1), ("m{k}", "g", 8, 1), ("v", "r", 9, 1), ("v", "s", 9, 0), ("gen", "use", 12, 2), ("gen", "k", 12, 1)],
        [("constructor", 4, 4), ("m{k}", 5, 8), ("v", 9, 9), ("gen", 12, 12)],
    ),
    "c": (
        '#include <stdio.h>\n#define M(x) f(x)\nstatic int add(int a, int b);\nstruct P *make{k}(void)\n{\n  char *s = "no() {"; int (*fp)(int) = 0;\n  for (int i = 0; i < len(s); i++) { p->cb{k}(i, sizeof(int), add(1, 2)); }\n  return a * mul(3, (4, 5));\n}\n',
        [("make{k}", "len", 7, 1), ("make{k}", "cb{k}", 7, 3), ("make{k}", "add", 7, 2), ("make{k}", "mul", 8, 2)],
        [("make{k}", 4, 9)],
    ),
    "cpp": (
        "namespace n { class A : public B { public: A(int x) : B(x), y(mk(1)) { go(); } ~A();\n  virtual int v{k}() const override { return obj.m<int>(1) + obj.k(2, {3, 4}); } };\n}\ntemplate <typename T> std::vector<T> A::w{k}(T a, std::map<int, T> b) noexcept {\n  auto l = [&](int q) { return inner(q); };\n  ns::free(a); return l(1), new C(dd{k}(1)); }\n",
        [("A", "mk", 1, 1), ("A", "go", 1, 0), ("v{k}", "k", 2, 2), ("w{k}", "inner", 5, 1), ("w{k}", "l", 6, 1), ("w{k}", "dd{k}", 6, 1)],
        [("A", 1, 1), ("v{k}", 2, 2), ("w{k}", 4, 6)],
    ),
    "f90": (
        "module m\ncontains\nsubroutine s{k}(a, b)\n  real :: a(10), b\n  ! call no(1)\n  call t{k}(a(1), f(b, 2))\n  if (cond(a)) then\n    x = y%get(1)\n  end if\ncontains\n  function f(u, v) result(r)\n    r = g('x(', u)\n  end function f\nend subroutine s{k}\nprogram main\n  call noargs\n  call s{k}(1, 2)\nend program\nend module\n",
        [("s{k}", "t{k}", 6, 2), ("s{k}", "a", 6, 1), ("s{k}", "f", 6, 2), ("s{k}", "cond", 7, 1), ("s{k}", "get", 8, 1), ("f", "g", 12, 2), ("<module>", "noargs", 16, 0), ("<module>", "s{k}", 17, 2)],
        [("s{k}", 3, 14), ("f", 11, 13)],
    ),
}


def _sources(s, d):
    own = F.lit(None).cast("string")
    ext = F.lit(None).cast("string")
    for n, (kind, (source, *_)) in enumerate(SHAPES.items()):
        own = F.when(F.col("p_partkey") % len(SHAPES) == n, F.lit(source)).otherwise(own)
        ext = F.when(F.col("p_partkey") % len(SHAPES) == n, F.lit(kind)).otherwise(ext)
    key = F.col("p_partkey").cast("string")
    content = F.concat(F.repeat(F.lit("\n"), F.col("p_size") % 4), F.replace(own, F.lit("{k}"), key))
    parts = spread_rows(table(s, d, "part").select("p_partkey", "p_size"), "p_partkey")  # keys are shuffled, the sources are made behind that
    return parts.select(F.concat(F.lit("b"), "p_partkey", F.lit("."), ext).alias("path"), content.alias("content"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_CALLS = _values((n, *c) for n, (_, calls, _) in enumerate(SHAPES.values()) for c in calls)
_FUNCTIONS = _values((n, *f) for n, (_, _, functions) in enumerate(SHAPES.values()) for f in functions)
_EXT = "CASE p_partkey % 7 " + " ".join(f"WHEN {n} THEN '{k}'" for n, k in enumerate(SHAPES)) + " END"

QUERIES = {
    "e4_bracket_calls": lambda s, d: K.calls(_sources(s, d), spread=False).select("path", "caller", "callee", "line", "arg_count"),
    "e3_bracket_functions": lambda s, d: K.functions(_sources(s, d), spread=False),
}

ORACLES = {
    "e4_bracket_calls": f"SELECT 'b' || p_partkey || '.' || {_EXT} AS path, replace(caller, '{{k}}', CAST(p_partkey AS VARCHAR)) AS caller, replace(callee, '{{k}}', CAST(p_partkey AS VARCHAR)) AS callee, CAST(line + p_size % 4 AS INTEGER) AS line, CAST(n AS INTEGER) AS arg_count FROM part JOIN (VALUES {_CALLS}) v(shape, caller, callee, line, n) ON shape = p_partkey % 7",
    "e3_bracket_functions": f"SELECT 'b' || p_partkey || '.' || {_EXT} AS path, replace(name, '{{k}}', CAST(p_partkey AS VARCHAR)) AS name, CAST(line + p_size % 4 AS INTEGER) AS line, CAST(end_line + p_size % 4 AS INTEGER) AS end_line FROM part JOIN (VALUES {_FUNCTIONS}) v(shape, name, line, end_line) ON shape = p_partkey % 7",
}
