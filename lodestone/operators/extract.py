"""Functions, classes, calls, imports, references and definition/use sites of source files.

Python is parsed with ``ast``. Other languages are read by patterns over text whose comments and strings are blanked out, with
braces (or ``end``) giving the ranges: good for declarations, approximate for calls and references. One table-generating pass
(``extract``) makes rows of all kinds; the views below select one kind. A file that can't be parsed gives one row of kind ``error``.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lodestone.functions.paths import language_label
from lodestone.session import checkpointed, shuffled, spread_rows

ROW = "kind string, name string, line int, end_line int, col int, owner string, params string, return_type string, items array<string>, n_args int, access string"
FIELDS = [f.split()[0] for f in ROW.split(", ")]
MODULE = "<module>"


def row(kind: str, name: str, line: int, end: int | None = None, col: int = 0, owner: str | None = None, params: str | None = None, ret: str | None = None, items: list[str] | None = None, n_args: int | None = None, access: str | None = None) -> tuple:
    return kind, name, line, end or line, col, owner, params, ret, items or [], n_args, access


# ---------------------------------------------------------------- Python


#: Kinds of rows that come from statements alone: no expression holds a function, class or import.
STATEMENTS = frozenset(("function", "class", "import"))


class _Python(ast.NodeVisitor):
    """Rows of all kinds; with ``kinds``, of these only, and expressions are visited only if some of the kinds are found there."""

    def __init__(self, kinds: frozenset[str] | None = None) -> None:
        self.rows: list[tuple] = []
        self.scope: list[tuple[str, str]] = []
        self.kinds = kinds
        self.shallow = kinds is not None and kinds <= STATEMENTS

    def wants(self, kind: str) -> bool:
        return self.kinds is None or kind in self.kinds

    def generic_visit(self, node) -> None:
        if not self.shallow:
            return super().generic_visit(node)
        for field in ("body", "handlers", "cases", "orelse", "finalbody"):
            for x in v if isinstance(v := getattr(node, field, None), list) else ():
                self.visit(x)

    def inside(self) -> str:
        return next((n for k, n in reversed(self.scope) if k == "f"), MODULE)

    def function(self, node) -> None:
        a = node.args
        if self.wants("function"):
            owner = self.scope[-1][1] if self.scope and self.scope[-1][0] == "c" else None
            self.rows.append(row("function", node.name, node.lineno, node.end_lineno, node.col_offset, owner, ast.unparse(a), ast.unparse(node.returns) if node.returns else None))
        for note in [*(x.annotation for x in [*a.posonlyargs, *a.args, *a.kwonlyargs]), node.returns] if self.wants("reference") else ():
            self.types(note)
        for d in () if self.shallow else node.decorator_list:
            self.visit(d)
        self.scope.append(("f", node.name))
        for x in () if self.shallow else [*a.defaults, *[d for d in a.kw_defaults if d]]:
            self.visit(x)
        for x in node.body:
            self.visit(x)
        self.scope.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def types(self, note) -> None:
        for x in ast.walk(note) if note is not None else ():
            if isinstance(x, ast.Name):
                self.rows.append(row("reference", x.id, x.lineno, col=x.col_offset, owner=self.inside()))

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        if self.wants("class"):
            bases = [ast.unparse(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
            fields = [t.id for x in node.body if isinstance(x, (ast.Assign, ast.AnnAssign)) for t in (x.targets if isinstance(x, ast.Assign) else [x.target]) if isinstance(t, ast.Name)]
            self.rows.append(row("class", node.name, node.lineno, node.end_lineno, node.col_offset, None, ",".join(fields), None, bases))
        self.scope.append(("c", node.name))
        for x in node.body if self.shallow else [*node.decorator_list, *node.bases, *node.body]:
            self.visit(x)
        self.scope.pop()

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
        if name and self.wants("call"):
            self.rows.append(row("call", name, node.lineno, node.end_lineno, node.col_offset, self.inside(), n_args=len(node.args) + len(node.keywords)))
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.rows.append(row("import", a.name, node.lineno, items=[]))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self.rows.append(row("import", "." * node.level + (node.module or ""), node.lineno, items=[a.name for a in node.names]))

    def visit_Name(self, node: ast.Name) -> None:
        if self.wants("site"):
            self.rows.append(row("site", node.id, node.lineno, col=node.col_offset, owner=self.inside(), access="read" if isinstance(node.ctx, ast.Load) else "write"))

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        if isinstance(node.target, ast.Name):
            t = node.target
            if self.wants("site"):
                self.rows.append(row("site", t.id, t.lineno, col=t.col_offset, owner=self.inside(), access="write_read"))
            if not self.shallow:
                self.visit(node.value)
        else:
            self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if self.shallow:
            return
        if self.wants("reference"):
            self.types(node.annotation)
        self.visit(node.target)
        if node.value:
            self.visit(node.value)


def python_rows(source: str, kinds: frozenset[str] | None = None) -> list[tuple]:
    v = _Python(kinds)
    v.visit(ast.parse(source))
    return v.rows


def exports(source: str) -> list[str]:
    """``__all__`` if it is a list of strings, else the public functions and classes of the module."""
    body = ast.parse(source).body
    for x in body:
        if isinstance(x, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in x.targets) and isinstance(x.value, (ast.List, ast.Tuple)):
            return [e.value for e in x.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    return [x.name for x in body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and not x.name.startswith("_")]


# ---------------------------------------------------------------- languages with braces, Fortran, Markdown

_ID = r"[A-Za-z_$][\w$]*"
#: Parameters that may hold objects and calls, one level deep.
_PARAMS = r"\((?:[^(){}]|\{[^{}]*\}|\([^()]*\))*\)"
KEYWORDS = frozenset("if else for while switch catch return match loop sizeof function fn func def class struct do try throw await typeof in of unsafe move use where select case defer when using lock foreach fixed nameof super this constructor".split())
#: Patterns of each language: functions (name, params, return type), classes, imports, inheritance.
LANGUAGES: dict[str, dict[str, str]] = {
    "rust": {"function": rf"\bfn\s+(?P<name>{_ID})\s*(?:<[^({{]*>)?\s*(?P<params>\([^{{;]*?\))\s*(?:->\s*(?P<ret>[^{{;]+?))?\s*(?:where[^{{;]*)?(?=[{{;])", "class": rf"\b(?:struct|enum|trait|union)\s+(?P<name>{_ID})", "import": r"^[ \t]*(?:pub\s+)?use\s+(?P<name>[^;]+);"},
    "go": {"function": rf"^func\s+(?:\((?P<owner>[^)]*)\)\s*)?(?P<name>{_ID})\s*(?:\[[^\]]*\])?(?P<params>\([^{{]*?\))\s*(?P<ret>[^{{\n]*?)\s*(?=\{{)", "class": rf"^type\s+(?P<name>{_ID})\s+(?:struct|interface)\b", "import": r"^[ \t]*(?:import\s+)?(?:[\w.]+\s+)?\"(?P<name>[^\"\n]+)\"[ \t]*$"},
    "java": {"function": rf"(?:^|[;{{}}])\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*(?:<[^>]+>\s*)?(?P<ret>[\w<>\[\],.?]+)\s+(?P<name>{_ID})\s*(?P<params>\([^;{{)]*\))\s*(?:throws[^{{;]+)?(?=[{{;])", "class": rf"\b(?:class|interface|enum|record)\s+(?P<name>{_ID})(?P<bases>[^{{;]*)", "import": r"^[ \t]*import\s+(?:static\s+)?(?P<name>[\w.*]+)\s*;"},
    "csharp": {"function": rf"(?:^|[;{{}}])\s*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|virtual|override|async|sealed|abstract|partial)\s+)+(?P<ret>[\w<>\[\],.?]+)\s+(?P<name>{_ID})\s*(?:<[^>]*>)?(?P<params>\([^;{{]*?\))\s*(?=[{{;=])", "class": rf"\b(?:class|interface|struct|enum|record)\s+(?P<name>{_ID})(?P<bases>[^{{;]*)", "import": r"^[ \t]*using\s+(?P<name>[\w.]+)\s*;"},
    "kotlin": {"function": rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w<>]+\.)?(?P<name>{_ID})\s*(?P<params>\([^{{=]*?\))\s*(?::\s*(?P<ret>[\w<>?., ]+?))?\s*(?=[{{=\n])", "class": rf"\b(?:class|interface|object)\s+(?P<name>{_ID})(?P<bases>[^{{\n]*)", "import": r"^[ \t]*import\s+(?P<name>[\w.*]+)"},
    "typescript": {"function": rf"\bfunction\s*\*?\s*(?P<name>{_ID})\s*(?:<[^(]*>)?(?P<params>{_PARAMS})\s*(?::\s*(?P<ret>[^{{\n]+?))?\s*(?=\{{)|^[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*(?P<name2>{_ID})\s*(?:<[^(]*>)?(?P<params2>{_PARAMS})\s*(?::\s*(?P<ret2>[^{{;\n]+?))?\s*(?=\{{)|\b(?:const|let|var)\s+(?P<name3>{_ID})\s*(?::[^=]+)?=\s*(?:async\s*)?(?P<params3>{_PARAMS})\s*(?::[^=]+)?=>", "class": rf"\b(?:class|interface|enum)\s+(?P<name>{_ID})(?P<bases>[^{{;]*)", "import": r"^[ \t]*(?:import\b[^;\n]*?['\"](?P<name>[^'\"\n]+)['\"]|(?:const|let|var)\s+[^=\n]+=\s*require\(['\"](?P<name2>[^'\"\n]+)['\"]\))"},
    "cpp": {"function": rf"^[ \t]*(?:template\s*<[^>]*>\s*)?(?P<ret>[A-Za-z_][\w:<>,*&\s]*?[\s*&])(?P<name>~?[A-Za-z_][\w:~]*)\s*(?P<params>\([^;{{}}]*\))\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?=\{{)", "class": rf"\b(?:class|struct|enum(?:\s+class)?|union)\s+(?P<name>{_ID})(?P<bases>[^{{;()]*)(?=\{{)", "import": r"^[ \t]*#\s*include\s*[<\"](?P<name>[^>\"\n]+)[>\"]"},
}
LANGUAGES["c"] = LANGUAGES["cpp"]
LANGUAGES["javascript"] = LANGUAGES["tsx"] = LANGUAGES["typescript"]
_COMPILED = {k: {n: re.compile(p, re.M) for n, p in v.items()} for k, v in LANGUAGES.items()}
#: Groups of each pattern by what they hold: those of its alternatives are numbered.
_GROUPS: dict[re.Pattern, dict[str, list[str]]] = {p: {n: [g for g in p.groupindex if g.rstrip("0123456789") == n] for n in ("name", "params", "ret", "bases")} for v in _COMPILED.values() for p in v.values()}
_BRACES = re.compile(r"[{};]")
_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n]){1,2}'", re.S)
_CALL = re.compile(rf"(?:(?P<scope>(?:{_ID}\s*(?:::|\.|->)\s*)+))?(?P<name>{_ID})\s*(?:::<[^>]*>)?!?\(")
_IMPL = re.compile(rf"\bimpl\s*(?:<[^{{]*?>\s*)?(?:(?P<trait>[\w:]+)(?:<[^{{]*?>)?\s+for\s+)?(?P<type>{_ID})(?:<[^{{]*>)?\s*(?:where[^{{]*)?\{{")
_TYPE = re.compile(r"(?<![\w.])[A-Z]\w*")
_NAME = re.compile(rf"(?<![\w.]){_ID}\b")


#: Single quotes hold texts of any length.
_SCRIPT_NOISE = re.compile(_NOISE.pattern.removesuffix("{1,2}'") + "*'", re.S)


def blanked(source: str, imports: bool = False, script: bool = False) -> str:
    """The text without comments and strings, every character in place."""
    return (_SCRIPT_NOISE if script else _NOISE).sub(lambda m: m[0] if imports and m[0][:2] not in ("//", "/*") else re.sub(r"[^\n]", " ", m[0]) if "\n" in m[0] else " " * len(m[0]), source)


def _close(text: str, at: int) -> int:
    """Where the brace closes that opens at or after ``at``; the line's end if a semicolon comes first."""
    depth = 0
    for m in _BRACES.finditer(text, at):
        c = m[0]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return m.start()
        elif not depth:
            return m.start()
    return len(text) - 1


def brace_rows(source: str, language: str, kinds: frozenset[str] | None = None) -> list[tuple]:
    """Rows of all kinds; with ``kinds``, of these only, and nothing is looked for that none of them needs."""
    wants = lambda *some: kinds is None or not kinds.isdisjoint(some)
    found_too = lambda kind, matches: matches() if wants(kind) else ()
    script = language in ("typescript", "tsx", "javascript")
    rules, text = _COMPILED[language], blanked(source, script=script)
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    import bisect

    line = lambda at: bisect.bisect_right(starts, at)
    col = lambda at: at - starts[line(at) - 1]
    pick = lambda m, n: next((v for g in _GROUPS[m.re][n] if (v := m[g]) is not None), None)
    rows, spans, classes = [], [], []
    # A function's owner is a class or impl block, the place of a call, reference or site a function.
    for m in rules["class"].finditer(text) if wants("class", "function") else ():
        end = _close(text, m.end())
        classes.append((m["name"], m.start(), end))
        if not wants("class"):
            continue
        bases = (pick(m, "bases") or "").strip()
        if language in ("typescript", "tsx", "javascript", "java"):
            found = [f"{k} {b.strip()}" for k, names in re.findall(r"\b(extends|implements)\s+((?:[\w.<>]+\s*,?\s*)+?)(?=\b(?:extends|implements)\b|$)", bases) for b in names.split(",") if b.strip()]
        else:
            found = [re.sub(r"\b(public|private|protected|virtual)\b|\(.*", "", b).strip() for b in bases.partition(":")[2].split(",") if b.strip()]
        rows.append(row("class", m["name"], line(m.start("name")), line(end), col(m.start("name")), items=found))
    impls = []
    if language == "rust" and wants("impl_trait", "function"):
        for m in _IMPL.finditer(text):
            end = _close(text, m.end() - 1)
            impls.append((m["type"], m.start(), end))
            if m["trait"] and "::" not in m["trait"]:
                rows.append(row("impl_trait", m["trait"], line(m.start()), line(end), owner=m["type"]))
    owners = sorted([*impls, *classes], key=lambda x: -x[1])
    for m in rules["function"].finditer(text) if wants("function", "call", "reference", "site") else ():
        name = pick(m, "name")
        if name in KEYWORDS or (pick(m, "ret") or "").strip() in KEYWORDS | {"new"}:
            continue
        at = next(m.start(k) for k in _GROUPS[m.re]["name"] if m[k] is not None)
        end = _close(text, m.end())
        bare = name.rsplit("::", 1)[-1]
        spans.append((at, end, bare))
        if not wants("function"):
            continue
        owner = next((n for n, s, e in owners if s < at <= e), None)
        rows.append(row("function", bare, line(at), line(end), col(at), owner, (pick(m, "params") or "").strip(), (pick(m, "ret") or "").strip() or None))
    inside = lambda at: max(((s, n) for s, e, n in spans if s < at <= e), default=(0, MODULE))[1]
    named = {s for s, _, _ in spans}
    for m in found_too("call", lambda: _CALL.finditer(text)):
        at = m.start("name")
        if m["name"] in KEYWORDS or at in named:
            continue
        depth, k, n, some = 1, m.end(), 0, False
        while k < len(text) and depth:
            c = text[k]
            depth += (c in "([{") - (c in ")]}")
            n += c == "," and depth == 1
            some |= not c.isspace() and depth > 0
            k += 1
        rows.append(row("call", re.sub(r"\s+", "", m["scope"] or "").replace("->", ".") + m["name"], line(at), line(k - 1), col(at), inside(at), n_args=n + 1 if some or source[m.end() : k - 1].strip() else 0))
    for m in found_too("import", lambda: rules["import"].finditer(blanked(source, imports=True, script=script))):
        name = (pick(m, "name") or "").strip()
        if language == "rust":
            rows += [row("import", p, line(m.start()), items=i) for p, i in use_tree(name)]
        else:
            rows.append(row("import", name, line(m.start())))
    seen = set()
    for m in found_too("reference", lambda: _TYPE.finditer(text)):
        if m[0] not in seen:
            seen.add(m[0])
            rows.append(row("reference", m[0], line(m.start()), col=col(m.start()), owner=inside(m.start())))
    for m in found_too("site", lambda: _NAME.finditer(text)):
        if m[0] in KEYWORDS:
            continue
        after = text[m.end() : m.end() + 3].lstrip()
        access = "write_read" if re.match(r"[-+*/%&|^]=", after) else "write" if re.match(r"=(?!=|>)|:=", after) else "read"
        rows.append(row("site", m[0], line(m.start()), col=col(m.start()), owner=inside(m.start()), access=access))
    return rows


def use_tree(path: str) -> list[tuple[str, list[str]]]:
    """Modules and items of a Rust use declaration with nested braces."""
    path = re.sub(r"\s+", " ", path.strip())
    if "{" not in path:
        path = path.split(" as ")[0]
        head, _, last = path.rpartition("::")
        return [(head or last, [last] if head else [])]
    head, _, rest = path.partition("{")
    head, rest = head.rstrip(": "), rest.rsplit("}", 1)[0]
    parts, depth, cur = [], 0, ""
    for c in rest:
        if c == "," and not depth:
            parts.append(cur)
            cur = ""
            continue
        depth += (c == "{") - (c == "}")
        cur += c
    parts = [p.strip() for p in [*parts, cur] if p.strip()]
    plain = [p.split(" as ")[0] for p in parts if "::" not in p and "{" not in p]
    out = [(head, plain)] if plain else []
    for p in parts:
        if "::" in p or "{" in p:
            out += use_tree(f"{head}::{p}" if head else p)
    return out


_FORTRAN = re.compile(r"^[ \t]*(?:(?:pure|elemental|recursive|impure|module)\s+|(?:integer|real|logical|complex|character|type|double\s+precision)(?:\s*\([^)]*\))?\s+)*(?P<kind>subroutine|function|module|program|type)\s*(?:::)?\s*(?!procedure\b)(?P<name>[a-z]\w*)\s*(?P<params>\([^)]*\))?", re.I | re.M)
_FORTRAN_END = re.compile(r"^[ \t]*end\s*(subroutine|function|module|program|type)?\b[^\n]*$", re.I | re.M)


def fortran_rows(source: str) -> list[tuple]:
    text = re.sub(r"![^\n]*", lambda m: " " * len(m[0]), source)
    line = lambda at: source.count("\n", 0, at) + 1
    marks = sorted([(m.start(), 0, m) for m in _FORTRAN.finditer(text) if not text[m.start() : m.end()].lower().lstrip().startswith("end")] + [(m.start(), 1, m) for m in _FORTRAN_END.finditer(text) if m[1]], key=lambda x: x[0])
    rows, stack, spans = [], [], []
    for at, is_end, m in marks:
        if not is_end:
            stack.append(m)
        elif stack:
            o = stack.pop()
            kind = o["kind"].lower()
            if kind in ("subroutine", "function"):
                rows.append(row("function", o["name"], line(o.start("name")), line(at), params=o["params"] or ""))
                spans.append((o.start(), at, o["name"]))
    inside = lambda at: max(((s, n) for s, e, n in spans if s < at <= e), default=(0, MODULE))[1]
    rows += [row("import", m[1], line(m.start())) for m in re.finditer(r"^[ \t]*use\s+(?:,\s*\w+\s*::\s*)?(\w+)", text, re.I | re.M)]
    rows += [row("call", m[1], line(m.start()), owner=inside(m.start())) for m in re.finditer(r"\bcall\s+(\w+)", text, re.I)]
    return rows


def markdown_rows(source: str) -> list[tuple]:
    out, fence = [], False
    for k, x in enumerate(source.split("\n"), 1):
        if x.lstrip().startswith("```"):
            fence = not fence
        elif not fence and (m := re.match(r"#{1,6}\s+(.+?)\s*#*$", x)):
            out.append(row("class", m[1], k))
    return out


def html_rows(source: str) -> list[tuple]:
    line = lambda at: source.count("\n", 0, at) + 1
    out = [row("class", re.sub(r"<[^>]+>", "", m[2]).strip(), line(m.start())) for m in re.finditer(r"<h([1-6])[^>]*>(.*?)</h\1>", source, re.S | re.I)]
    return out + [row("import", m[1], line(m.start())) for m in re.finditer(r"(?:href|src)=\"([^\"]+)\"", source)]


def keys_rows(source: str, language: str) -> list[tuple]:
    from lodestone.operators.text import PATTERNS

    rule, css = re.compile(PATTERNS[language]), language == "css"
    lines = [x.lstrip() if css else x for x in source.split("\n")]
    return [row("function", x.rstrip(" \t\r,:{") if css else m[1], k) for k, x in enumerate(lines, 1) if (m := rule.match(x))]


#: Languages and what reads them.
READERS = {"python": python_rows, "fortran": fortran_rows, "markdown": markdown_rows, "html": html_rows} | {k: (lambda s, k=k: brace_rows(s, k)) for k in LANGUAGES} | {k: (lambda s, k=k: keys_rows(s, k)) for k in ("css", "yaml", "json", "toml")}


def astro_rows(source: str, kinds: frozenset[str] | None = None) -> list[tuple]:
    m = re.match(r"---[ \t]*\n(.*?)^---[ \t]*$", source, re.S | re.M)
    return [(r[0], r[1], r[2] + 1, r[3] + 1, *r[4:]) for r in brace_rows(m[1], "typescript", kinds)] if m else []


READERS["astro"] = astro_rows


def register_language(name: str, reader: Callable[[str], list[tuple]]) -> None:
    """Files of the language ``name`` are read by ``reader``, which gives rows made by ``row``. Kept by the session's Python and sent along with each extraction."""
    if not name or name != name.lower():
        raise ValueError("a language's name is in lower case")
    READERS[name] = reader


def rows_of(source: str, language: str, readers: dict | None = None, kinds: frozenset[str] | None = None) -> list[tuple]:
    """Rows of the ``kinds`` (all: None), and of kind ``error``."""
    readers = readers_of(kinds) if readers is None else readers
    try:
        rows = readers[language](source) if source and language in readers else []
        return rows if kinds is None else [r for r in rows if r[0] in kinds or r[0] == "error"]
    except (SyntaxError, ValueError, RecursionError) as e:
        return [row("error", type(e).__name__, 0, params=str(e)[:200])]


_BUILT_IN = dict(READERS)
#: Readers that look for some kinds only.
_SELECTIVE = {"python": python_rows, "astro": astro_rows} | {k: (lambda s, kinds, k=k: brace_rows(s, k, kinds)) for k in LANGUAGES}


def readers_of(kinds: frozenset[str] | None) -> dict[str, Callable[[str], list[tuple]]]:
    """What reads each language, those of ``_SELECTIVE`` looking for ``kinds`` only (all: None)."""
    return dict(READERS) if kinds is None else READERS | {k: (lambda s, read=read: read(s, kinds)) for k, read in _SELECTIVE.items() if READERS[k] is _BUILT_IN[k]}


# ---------------------------------------------------------------- tables


def extract(sources: DataFrame, *kinds: str, spread: bool = True) -> DataFrame:
    """Rows of all kinds, or of ``kinds`` and errors, for (path, content), the language from the path or a column ``language``.

    With ``spread`` false, ``sources`` are read in the tasks they come in.
    """
    s = sources if "language" in sources.columns else sources.withColumn("language", language_label(F.col("path")))

    wanted = frozenset(kinds) or None
    readers = readers_of(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict(zip(FIELDS, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string()), strict=True))
        for batch in batches:
            paths, out = [], []
            for path, language, content in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content")), strict=True):
                own = rows_of(content or "", language, readers, wanted)
                paths += [path] * len(own)
                out += own
            cols = list(zip(*out, strict=True)) if out else [[] for _ in FIELDS]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *(pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True))], ["path", *FIELDS])

    s = s.select("path", "language", "content")
    return (spread_rows(s, "path") if spread else s).mapInArrow(run, f"path string, {ROW}")


def functions(x: DataFrame) -> DataFrame:
    """One for each name and line."""
    return x.filter("kind = 'function'").dropDuplicates(["path", "name", "line"]).select("path", "name", "line", "end_line", F.col("owner").alias("class"), F.col("params"), "return_type")


def classes(x: DataFrame) -> DataFrame:
    """T5, with fields and bases."""
    return x.filter("kind = 'class'").select("path", "name", "line", "end_line", F.split(F.coalesce("params", F.lit("")), ",").alias("fields"), F.col("items").alias("inherits"))


def calls(x: DataFrame) -> DataFrame:
    """T6."""
    return x.filter("kind = 'call'").select("path", F.col("owner").alias("caller"), F.col("name").alias("callee"), "line", F.col("col").alias("column"), F.col("n_args").alias("arg_count"))


def imports(x: DataFrame) -> DataFrame:
    """T8."""
    return x.filter("kind = 'import'").select("path", F.col("name").alias("module"), "items", "line")


def references(x: DataFrame) -> DataFrame:
    """The first place of each name in a file."""
    w = Window.partitionBy("path", "name").orderBy("line", "col")
    return x.filter("kind = 'reference'").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("path", F.col("name").alias("symbol"), F.lit("type").alias("reference_type"), "line")


def impl_traits(x: DataFrame) -> DataFrame:
    """T9."""
    return x.filter("kind = 'impl_trait'").select("path", F.col("name").alias("trait_name"), F.col("owner").alias("impl_type"), "line")


def impl_methods(x: DataFrame) -> DataFrame:
    """Functions of an impl block with the first class of that name in the file, from one pass over ``x``."""
    both = x.filter("kind in ('function', 'class')").withColumn("class", F.when(F.col("kind") == "class", F.col("name")).otherwise(F.col("owner"))).filter("class is not null")
    first = F.min(F.when(F.col("kind") == "class", F.col("line"))).over(Window.partitionBy("path", "class"))
    found = both.withColumn("class_line", first).filter("kind = 'function' and class_line is not null").dropDuplicates(["path", "name", "line"])
    return found.select("path", "class", "name", "line", "end_line", "params", "return_type", "class_line")


def counts(x: DataFrame) -> DataFrame:
    """Functions and classes of each file."""
    return x.groupBy("path").agg(F.count_distinct(F.when(F.col("kind") == "function", F.struct("name", "line"))).alias("function_count"), F.count_if(F.col("kind") == "class").alias("class_count"))


def call_frequency(x: DataFrame) -> DataFrame:
    """A7, T11."""
    return calls(x).groupBy("path", "callee").agg(F.count(F.lit(1)).alias("n"))


def def_use(x: DataFrame, symbol: str) -> DataFrame:
    """Sites of one symbol, reads at the place of a write left out, writes first."""
    from lodestone.operators.text import def_use_order

    s = x.filter((F.col("kind") == "site") & (F.col("name") == symbol)).select("path", F.col("access").alias("kind"), F.col("name").alias("symbol"), "line", F.col("col").alias("column"), F.col("owner").alias("enclosing_scope"))
    return def_use_order(checkpointed(s))  # writes, reads and their order are told from one extraction


def module_index(x: DataFrame) -> DataFrame:
    """Functions and imports of each file as arrays."""
    return x.filter("kind in ('function', 'import')").groupBy("path").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "function", F.struct("line", "name")))).alias("functions"), F.array_sort(F.collect_list(F.when(F.col("kind") == "import", F.struct(F.col("line"), F.col("name").alias("module"), "items")))).alias("imports"))


def wildcard_imports(x: DataFrame, sources: DataFrame) -> DataFrame:
    """From m import * with the names that m exports; relative modules climb directories, a file never imports itself."""
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    parts = F.split("path", "/")
    base = F.when(dots > 0, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots, F.lit(0))), "/")).otherwise("")
    rest = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    star = F.array_contains("items", "*")
    # A module is a file or the __init__ of a folder; other imports get keys that no module has.
    key = F.when(star, F.array_join(F.filter(F.array(base, rest), lambda c: c != ""), "/")).otherwise(F.concat(F.lit("\0"), "path"))

    def names_in(content):
        try:
            return exports(content or "")
        except (SyntaxError, ValueError, RecursionError):
            return None

    @F.pandas_udf("array<string>")
    def exported(contents: pd.Series) -> pd.Series:
        return contents.map(names_in)

    known = spread_rows(sources.select("path", "content").filter(F.endswith("path", F.lit(".py"))), "path").select(F.regexp_replace("path", r"(/__init__)?\.py$", "").alias("key"), F.struct(F.col("path").alias("target"), exported("content").alias("names")).alias("file"))
    known = shuffled(known.groupBy("key").agg(F.collect_list("file").alias("files")))  # two files a key, if paths don't repeat
    found = imports(x).withColumn("key", key).join(known, "key", "left")
    names = F.array_min(F.transform(F.filter("files", lambda f: f["target"] != F.col("path")), lambda f: f["names"]))
    return found.select("path", "module", F.coalesce(names, F.col("items")).alias("items"), "line")


@udtf(returnType="capture string, text string, line int, start int, end int", useArrow=True)
class QueryCaptures:
    """Named groups of a pattern over a text: ``FROM s, LATERAL query_captures(content, pattern)``."""

    def eval(self, content: str, pattern: str):
        feeds = [m.start() for m in re.finditer("\n", content or "")]
        for m in re.finditer(pattern, content or "", re.M):
            for name, text in (m.groupdict() or {"match": m[0]}).items():
                if text is not None:
                    at = m.start(name) if m.groupdict() else m.start()
                    yield name, text, bisect_left(feeds, at) + 1, at, at + len(text)


def register(spark) -> None:
    spark.udtf.register("query_captures", QueryCaptures)
