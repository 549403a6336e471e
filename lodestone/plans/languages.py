"""Language program: sources of several shapes for each language, made for each part, and what must be found in them.

A part's key chooses the shape, goes into names (``{k}``), and its size moves everything down by up to three lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import extract as E
from lodestone.plans.extraction import parts

# Each shape: source, and the rows (kind, name, line) that are in it.
SHAPES: dict[str, tuple[str, list[tuple[str, list[tuple[str, str, int]]]]]] = {
    "python": ("py", [
        ("import os\nfrom .a{k} import b\n\n@dec('def no(): {')\ndef f{k}(x):\n    def inner{k}():\n        return '}'\n    return inner{k}\n", [("import", "os", 1), ("import", ".a{k}", 2), ("function", "f{k}", 5), ("function", "inner{k}", 6)]),
        ("class A{k}(B):\n    '''def no(): pass'''\n    x = 1\n    async def m{k}(self): ...\n    class In{k}:\n        def n{k}(self): pass\n", [("class", "A{k}", 1), ("function", "m{k}", 4), ("class", "In{k}", 5), ("function", "n{k}", 6)]),
        ("if True:\n    def g{k}(a, *b, c=1, **d): pass\n# def no(): pass\nh = lambda: 0\n", [("function", "g{k}", 2)]),
    ]),
    "rust": ("rs", [
        ("use std::{fmt, io::Read};\n/* fn no() {} */\npub struct S{k}<T> { x: T }\nimpl<T: Clone> S{k}<T> {\n    pub async fn m{k}(&self, s: &str) -> Vec<T> where T: Copy { let c = \"fn no() {\"; vec![] }\n}\n", [("import", "std", 1), ("import", "std::io", 1), ("class", "S{k}", 3), ("function", "m{k}", 5)]),
        ("pub enum E{k} { A, B }\npub trait T{k} { fn req{k}(&self); fn def{k}(&self) -> i32 { 1 } }\nmod inner { pub(crate) fn deep{k}() {} }\n", [("class", "E{k}", 1), ("class", "T{k}", 2), ("function", "req{k}", 2), ("function", "def{k}", 2), ("function", "deep{k}", 3)]),
        ("// fn no() {}\nfn main() {\n    let f = |x: i32| { x + 1 };\n    help{k}(f(1));\n}\nfn help{k}<'a>(x: i32) -> Option<&'a str> { None }\n", [("function", "main", 2), ("function", "help{k}", 6)]),
    ]),
    "go": ("go", [
        ("package p\nimport (\n\t\"fmt\"\n\tx \"a/b{k}\"\n)\nfunc F{k}(a int, b ...string) (int, error) {\n\ts := \"func no() {\"\n\treturn 0, nil\n}\n", [("import", "fmt", 3), ("import", "a/b{k}", 4), ("function", "F{k}", 6)]),
        ("package p\ntype S{k} struct {\n\tx int\n}\nfunc (s *S{k}) M{k}() string { return `}` }\ntype I{k} interface { Do() }\n", [("class", "S{k}", 2), ("function", "M{k}", 5), ("class", "I{k}", 6)]),
        ("package p\n// func no() {}\nfunc G{k}[T any](x T) T {\n\tf := func() {}\n\tf()\n\treturn x\n}\n", [("function", "G{k}", 3)]),
    ]),
    "java": ("java", [
        ("import java.util.List;\npublic class A{k} extends B implements C, D {\n  private int x;\n  @Override\n  public <T> List<T> m{k}(int a) throws E { return null; }\n  A{k}() { }\n}\n", [("import", "java.util.List", 1), ("class", "A{k}", 2), ("function", "m{k}", 5)]),
        ("interface I{k} {\n  void req{k}(String s);\n  /* void no() { */\n  default int d{k}() { String s = \"int no() {\"; return 1; }\n}\n", [("class", "I{k}", 1), ("function", "req{k}", 2), ("function", "d{k}", 4)]),
        ("enum E{k} { A, B; static int n{k}(int[] x) { if (x.length > 0) { return 1; } return 0; } }\n", [("class", "E{k}", 1), ("function", "n{k}", 1)]),
    ]),
    "csharp": ("cs", [
        ("using System.Text;\nnamespace N {\n  public class A{k} : B, I {\n    public async Task<int> M{k}(string s) { return 0; }\n  }\n}\n", [("import", "System.Text", 1), ("class", "A{k}", 3), ("function", "M{k}", 4)]),
        ("public interface I{k} { }\npublic struct S{k} {\n  // public void No() { }\n  private static void P{k}() { var s = \"public void No() {\"; }\n}\n", [("class", "I{k}", 1), ("class", "S{k}", 2), ("function", "P{k}", 4)]),
        ("internal sealed class C{k} {\n  protected override string T{k}() => \"x\";\n}\n", [("class", "C{k}", 1), ("function", "T{k}", 2)]),
    ]),
    "kotlin": ("kt", [
        ("import a.b.C{k}\nclass A{k}(val x: Int) : B(), I {\n    override fun m{k}(s: String): Int { return 1 }\n}\n", [("import", "a.b.C{k}", 1), ("class", "A{k}", 2), ("function", "m{k}", 3)]),
        ("object O{k} {\n    fun one{k}() = 1\n    suspend fun <T> two{k}(x: T): T {\n        return x // fun no() {}\n    }\n}\n", [("class", "O{k}", 1), ("function", "one{k}", 2), ("function", "two{k}", 3)]),
        ("interface I{k}\nfun String.ext{k}(n: Int): String {\n    val s = \"fun no() {\"\n    return s\n}\n", [("class", "I{k}", 1), ("function", "ext{k}", 2)]),
    ]),
    "typescript": ("ts", [
        ("import { a } from './m{k}';\nexport async function f{k}<T>(x: T): Promise<T> {\n  const s = 'function no() {';\n  return x;\n}\n", [("import", "./m{k}", 1), ("function", "f{k}", 2)]),
        ("export class A{k} extends B implements I {\n  private x = 1;\n  m{k}(a: string): void {\n    if (a) { this.x = 2; }\n  }\n}\ninterface I{k} { y: number }\n", [("class", "A{k}", 1), ("function", "m{k}", 3), ("class", "I{k}", 7)]),
        ("const g{k} = (x: number) => {\n  return x; // function no() {}\n};\nenum E{k} { A }\n", [("function", "g{k}", 1), ("class", "E{k}", 4)]),
    ]),
    "tsx": ("tsx", [
        ("import React from 'react';\nexport function V{k}(p: P) {\n  return <div>{p.x}</div>;\n}\n", [("import", "react", 1), ("function", "V{k}", 2)]),
        ("const W{k} = (p: P) => {\n  return <p>function no()</p>;\n};\n", [("function", "W{k}", 1)]),
    ]),
    "javascript": ("js", [
        ("const fs = require('fs{k}');\nfunction* gen{k}() { yield 1; }\nclass A{k} extends B {\n  static m{k}() { return `}`; }\n}\n", [("import", "fs{k}", 1), ("function", "gen{k}", 2), ("class", "A{k}", 3), ("function", "m{k}", 4)]),
        ("import x from \"y{k}\";\nlet f{k} = async (a, b) => a;\n/* function no() {} */\nfunction h{k}(a = {}) {\n  return a;\n}\n", [("import", "y{k}", 1), ("function", "f{k}", 2), ("function", "h{k}", 4)]),
    ]),
    "c": ("c", [
        ("#include <stdio.h>\n#include \"my{k}.h\"\nstatic int add{k}(int a, int b)\n{\n  char *s = \"int no() {\";\n  return a + b;\n}\n", [("import", "stdio.h", 1), ("import", "my{k}.h", 2), ("function", "add{k}", 3)]),
        ("struct P{k} { int x; };\n/* int no() { } */\nstruct P{k} *make{k}(void) {\n  for (;;) { }\n}\n", [("class", "P{k}", 1), ("function", "make{k}", 3)]),
    ]),
    "cpp": ("cpp", [
        ("#include <vector>\ntemplate <typename T>\nT max{k}(T a, T b) { return a; }\nclass A{k} : public B {\n public:\n  int m{k}() const { return 1; }\n};\n", [("import", "vector", 1), ("function", "max{k}", 3), ("class", "A{k}", 4), ("function", "m{k}", 6)]),
        ("void A{k}::run{k}(int x) {\n  if (x) { return; }\n}\nenum class E{k} { X };\n", [("function", "run{k}", 1), ("class", "E{k}", 4)]),
    ]),
    "fortran": ("f90", [
        ("module m{k}\nuse iso_c\ncontains\nsubroutine s{k}(a)\n  call other(a)\nend subroutine\nreal function f{k}(x)\nend function\nend module\n", [("import", "iso_c", 2), ("function", "s{k}", 4), ("function", "f{k}", 7)]),
        ("! subroutine no()\npure subroutine p{k}()\nend subroutine p{k}\n", [("function", "p{k}", 2)]),
    ]),
    "markdown": ("md", [
        ("# Top {k}\ntext\n## Sub {k} ##\n```\n# no\n```\n###### Six {k}\n", [("class", "Top {k}", 1), ("class", "Sub {k}", 3), ("class", "Six {k}", 7)]),
        ("no heading\n#tag{k}\n", []),
    ]),
    "html": ("html", [
        ("<h1>Top <b>{k}</b></h1>\n<a href=\"/x{k}\">x</a>\n<script src=\"s{k}.js\"></script>\n", [("class", "Top {k}", 1), ("import", "/x{k}", 2), ("import", "s{k}.js", 3)]),
        ("<div>\n<h2 class=\"a\">Sub {k}</h2></div>\n", [("class", "Sub {k}", 2)]),
    ]),
    "astro": ("astro", [
        ("---\nimport L{k} from '../l{k}.astro';\nfunction f{k}(x: number) {\n  return x;\n}\n---\n<p>function no() {}</p>\n", [("import", "../l{k}.astro", 2), ("function", "f{k}", 3)]),
        ("<p>{k}</p>\n", []),
    ]),
}


def _rows(language: str):
    ext, shapes = SHAPES[language]

    def query(s, d):
        k = F.col("p_partkey")
        code = F.element_at(F.array(*[F.lit(c) for c, _ in shapes]), (k % len(shapes) + 1).cast("int"))
        feeds = F.lit(0) if language == "astro" else F.col("p_size") % 4  # frontmatter starts a file
        src = parts(s, d).select(F.concat(F.lit("p"), k, F.lit(f".{ext}")).alias("path"), F.concat(F.repeat(F.lit("\n"), feeds.cast("int")), F.replace(code, F.lit("{k}"), k.cast("string"))).alias("content"))
        return E.extract(src, "function", "class", "import", spread=False).filter("kind in ('function', 'class', 'import', 'error')").select("path", "kind", "name", "line").distinct()

    return query


def _sql(language: str) -> str:
    ext, shapes = SHAPES[language]
    q = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {q(kind)}, {q(name)}, {line})" for i, (_, found) in enumerate(shapes) for kind, name, line in found)
    feeds = "0" if language == "astro" else "p_size % 4"
    return f"SELECT DISTINCT 'p' || p_partkey || '.{ext}' AS path, kind, replace(name, '{{k}}', CAST(p_partkey AS VARCHAR)) AS name, CAST(line + {feeds} AS INTEGER) AS line FROM part JOIN (VALUES {rows}) v(shape, kind, name, line) ON p_partkey % {len(shapes)} = shape"


QUERIES = {f"e1_e3_{language}": _rows(language) for language in SHAPES}
ORACLES = {f"e1_e3_{language}": _sql(language) for language in SHAPES}
