"""Syntax trees as a table, and tree patterns as joins over it.

A tree is a row for each node: ``pre`` and ``post`` order, the parent's ``pre``, its place among its parent's children (from the left, and
whether it is the last), all ancestors, kind, field, the span in bytes and lines, and the text of nodes without children. Python
sources are read with ``ast`` and given the node kinds and field names of the usual grammar for editors, so that patterns
written for it can be used; any other table with these columns is as good (``X2``: a reader for a language is added to ``TREES``).

A pattern is an S-expression::

    (class_definition name: (identifier) @class body: (block (function_definition name: (identifier) @method)))
    ((call function: [(identifier) (attribute)] @f arguments: (argument_list . (string) @first)) (#match? @f "^open"))

with kinds, ``_`` and ``(_)`` for any node, fields, ``!field`` for one that must be missing, alternatives ``[...]``, ``?``, ``*`` and ``+`` behind a child, anchors ``.``,
captures ``@name`` and the predicates ``#eq?``, ``#not-eq?``, ``#match?``, ``#not-match?``, ``#any-of?`` and ``#not-any-of?``. ``>>`` before a child lets it be at any depth, which the usual language lacks.
Unnamed nodes (``"="``) are not in the trees and so an error, as is an unknown kind.

Each pattern node is a filter on the table, each step to a child an equi-join on (path, parent), each ``>>`` one on (path, ancestor): hot files are spread over their
nodes, and kinds and predicates of leaves are filtered before the joins. Captures come as rows, in match order.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import checkpointed, shuffled, spread_rows

NODE = "path string, pre int, post int, parent int, place int, is_last boolean, above array<int>, kind string, field string, start_byte int, end_byte int, start_line int, end_line int, text string"

# ---------------------------------------------------------------- Python sources

#: Kinds and fields of the grammar by the class and attribute of ``ast``; what is None has no field.
KINDS: dict[str, tuple[str, dict[str, str]]] = {
    "Module": ("module", {}), "Return": ("return_statement", {}), "Delete": ("delete_statement", {}), "Raise": ("raise_statement", {"cause": "cause"}), "Assert": ("assert_statement", {}),
    "Global": ("global_statement", {}), "Nonlocal": ("nonlocal_statement", {}), "Pass": ("pass_statement", {}), "Break": ("break_statement", {}), "Continue": ("continue_statement", {}), "Expr": ("expression_statement", {}),
    "AugAssign": ("augmented_assignment", {"target": "left", "value": "right"}), "AnnAssign": ("assignment", {"target": "left", "annotation": "type", "value": "right"}), "NamedExpr": ("named_expression", {"target": "name", "value": "value"}),
    "BinOp": ("binary_operator", {"left": "left", "right": "right"}), "UnaryOp": ("unary_operator", {"operand": "argument"}), "IfExp": ("conditional_expression", {}), "Compare": ("comparison_operator", {}), "Await": ("await", {}), "Yield": ("yield", {}), "YieldFrom": ("yield", {}),
    "Attribute": ("attribute", {"value": "object"}), "Subscript": ("subscript", {"value": "value", "slice": "subscript"}), "Starred": ("list_splat", {}), "List": ("list", {}), "Tuple": ("tuple", {}), "Set": ("set", {}), "Slice": ("slice", {}), "Name": ("identifier", {}),
    "ListComp": ("list_comprehension", {"elt": "body"}), "SetComp": ("set_comprehension", {"elt": "body"}), "GeneratorExp": ("generator_expression", {"elt": "body"}), "DictComp": ("dictionary_comprehension", {}), "JoinedStr": ("string", {}), "FormattedValue": ("interpolation", {"value": "expression"}),
    "For": ("for_statement", {"target": "left", "iter": "right"}), "AsyncFor": ("for_statement", {"target": "left", "iter": "right"}), "While": ("while_statement", {"test": "condition"}), "If": ("if_statement", {"test": "condition"}), "Match": ("match_statement", {"subject": "subject"}),
}
#: Kinds that the reader makes in other ways.
MADE = (
    "function_definition", "class_definition", "decorated_definition", "decorator", "parameters", "lambda", "lambda_parameters", "default_parameter", "typed_parameter", "typed_default_parameter", "list_splat_pattern", "dictionary_splat_pattern", "block", "type", "argument_list", "keyword_argument", "dictionary_splat",
    "call", "assignment", "import_statement", "import_from_statement", "aliased_import", "dotted_name", "wildcard_import", "with_statement", "with_clause", "with_item", "try_statement", "except_clause", "finally_clause", "else_clause", "elif_clause", "dictionary", "pair", "for_in_clause", "if_clause", "boolean_operator",
    "not_operator", "integer", "float", "string", "true", "false", "none", "ellipsis", "case_clause", "case_pattern",
)
#: Kinds that have no children, whose text is in the table.
LEAVES = {"identifier", "integer", "float", "true", "false", "none", "ellipsis", "pass_statement", "break_statement", "continue_statement", "wildcard_import", "dotted_name"}


class Node:
    __slots__ = ("children", "end", "field", "kind", "start")

    def __init__(self, kind: str, start: int, end: int, children: list | None = None, field: str | None = None) -> None:
        self.kind, self.start, self.end, self.field = kind, start, end, field
        self.children = sorted((c for c in children or [] if c is not None), key=lambda c: (c.start, -c.end))


def named(name: str, node: Node | None) -> Node | None:
    if node is not None:
        node.field = name
    return node


class PythonTree:
    def __init__(self, source: str) -> None:
        self.data = source.encode()
        self.lines = [0, *(m.end() for m in re.finditer(b"\n", self.data))]
        self.brackets: dict[int, int] = {}
        chars, opened = source.splitlines(keepends=True), []
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.OP and t.string in "()[]{}" and t.string:
                at = self.lines[t.start[0] - 1] + len(chars[t.start[0] - 1][: t.start[1]].encode())
                if t.string in "([{":
                    opened.append(at)
                elif opened:
                    self.brackets[opened.pop()] = at + 1

    def span(self, n) -> tuple[int, int]:
        return self.lines[n.lineno - 1] + n.col_offset, self.lines[n.end_lineno - 1] + n.end_col_offset

    def word(self, name: str, after: int) -> Node:
        """The identifier ``name`` at or after a place."""
        raw = name.encode()
        at = re.compile(rb"(?<![\w])" + re.escape(raw) + rb"(?![\w])").search(self.data, after)
        at = at.start() if at else after
        return Node("identifier", at, at + len(raw))

    def group(self, kind: str, after: int, before: int, children: list) -> Node | None:
        """A node over the brackets that open next."""
        at = self.data.find(b"(", after)
        at = after if at < 0 or at >= before else at
        return Node(kind, at, self.brackets.get(at, max([at, *(c.end for c in children if c)])), children)

    def block(self, body: list, name: str = "body") -> Node:
        own = [self.node(x) for x in body]
        return Node("block", own[0].start, own[-1].end, own, name)

    def annotation(self, n, name: str) -> Node | None:
        if n is None:
            return None
        inner = self.node(n)
        return Node("type", inner.start, inner.end, [inner], name)

    def parameter(self, a: ast.arg, default, splat: str = "") -> Node:
        s, e = self.span(a)
        out: Node = Node("identifier", s, s + len(a.arg.encode()))
        if splat:
            out = Node("list_splat_pattern" if splat == "*" else "dictionary_splat_pattern", self.data.rfind(splat.encode(), 0, s), out.end, [out])
        if a.annotation is not None:
            note = self.annotation(a.annotation, "type")
            if default is None:
                return Node("typed_parameter", out.start, e, [out, note])
            value = self.node(default)
            return Node("typed_default_parameter", s, value.end, [named("name", out), note, named("value", value)])
        if default is not None:
            value = self.node(default)
            return Node("default_parameter", s, value.end, [named("name", out), named("value", value)])
        return out

    def parameters(self, a: ast.arguments) -> list[Node]:
        plain = [*a.posonlyargs, *a.args]
        out = [self.parameter(x, d) for x, d in zip(plain, [None] * (len(plain) - len(a.defaults)) + a.defaults, strict=True)]
        out += [self.parameter(a.vararg, None, "*")] if a.vararg else []
        out += [self.parameter(x, d) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
        return out + ([self.parameter(a.kwarg, None, "**")] if a.kwarg else [])

    def clause(self, kind: str, body: list, more: list | None = None, name: str | None = None, inner: str = "body") -> Node:
        b = self.block(body, inner)
        own = [*(more or []), b]
        word = {"else_clause": b"else", "finally_clause": b"finally", "elif_clause": b"elif"}.get(kind)
        start = own[0].start
        if word:
            start = self.data.rfind(word, 0, start)
        return Node(kind, start, b.end, own, name)

    def arguments(self, n, after: int, args: list, keywords: list) -> Node | None:
        own = [self.node(x) for x in args]
        for k in keywords:
            s, e = self.span(k)
            value = self.node(k.value)
            own.append(Node("dictionary_splat", s, e, [value]) if k.arg is None else Node("keyword_argument", s, e, [named("name", Node("identifier", s, s + len(k.arg.encode()))), named("value", value)]))
        return self.group("argument_list", after, self.span(n)[1], own)

    def node(self, n, name: str | None = None) -> Node:
        out = getattr(self, f"of_{type(n).__name__}", self.plain)(n)
        if name:
            out.field = name
        return out

    def plain(self, n) -> Node:
        kind, fields = KINDS.get(type(n).__name__, (re.sub(r"(?<!^)(?=[A-Z])", "_", type(n).__name__).lower(), {}))
        own = []
        for key, value in ast.iter_fields(n):
            if key in ("body", "orelse", "finalbody") and isinstance(value, list) and isinstance(n, ast.stmt):
                if value:
                    own.append(self.block(value) if key == "body" else self.clause("else_clause", value, name="alternative"))
                continue
            for x in value if isinstance(value, list) else [value]:
                if isinstance(x, ast.comprehension):
                    left, right = self.node(x.target, "left"), self.node(x.iter, "right")
                    own.append(Node("for_in_clause", left.start, right.end, [left, right]))
                    own += [Node("if_clause", c.start, c.end, [c]) for c in map(self.node, x.ifs)]
                elif isinstance(x, (ast.expr, ast.stmt)):
                    own.append(self.node(x, fields.get(key)))
        s, e = (0, len(self.data)) if isinstance(n, ast.Module) else self.span(n)
        if isinstance(n, ast.Attribute):
            own.append(Node("identifier", e - len(n.attr.encode()), e, field="attribute"))
        if isinstance(n, (ast.Global, ast.Nonlocal)):
            at = s
            for x in n.names:
                own.append(self.word(x, at))
                at = own[-1].end
        return Node(kind, s, e, own)

    def of_Module(self, n) -> Node:
        return Node("module", 0, len(self.data), [self.node(x) for x in n.body])

    def of_FunctionDef(self, n) -> Node:
        s, e = self.span(n)
        name = named("name", self.word(n.name, self.data.index(b"def", s) + 3))
        body = self.block(n.body)
        out = Node("function_definition", s, e, [name, named("parameters", self.group("parameters", name.end, body.start, self.parameters(n.args))), self.annotation(n.returns, "return_type"), body])
        return self.decorated(n, out)

    of_AsyncFunctionDef = of_FunctionDef

    def of_ClassDef(self, n) -> Node:
        s, e = self.span(n)
        name, body = named("name", self.word(n.name, self.data.index(b"class", s) + 5)), self.block(n.body)
        at = self.data.find(b"(", name.end)
        bases = named("superclasses", self.arguments(n, name.end, n.bases, n.keywords)) if n.bases or n.keywords or 0 <= at < self.data.find(b":", name.end) else None
        return self.decorated(n, Node("class_definition", s, e, [name, bases, body]))

    def decorated(self, n, out: Node) -> Node:
        if not n.decorator_list:
            return out
        own = [Node("decorator", self.data.rfind(b"@", 0, x.start), x.end, [x]) for x in map(self.node, n.decorator_list)]
        return Node("decorated_definition", own[0].start, out.end, [*own, named("definition", out)])

    def of_Expr(self, n) -> Node:
        return Node("expression_statement", *self.span(n), [self.node(n.value)])

    def of_Assign(self, n) -> Node:
        right = self.node(n.value)
        for t in reversed(n.targets):
            left = self.node(t, "left")
            right = Node("assignment", left.start, right.end, [left, named("right", right)])
        return Node("expression_statement", *self.span(n), [right])

    def of_AugAssign(self, n) -> Node:
        return Node("expression_statement", *self.span(n), [self.plain(n)])

    def of_AnnAssign(self, n) -> Node:
        own = Node("assignment", *self.span(n), [self.node(n.target, "left"), self.annotation(n.annotation, "type"), self.node(n.value, "right") if n.value else None])
        return Node("expression_statement", own.start, own.end, [own])

    def of_Call(self, n) -> Node:
        f = self.node(n.func, "function")
        return Node("call", *self.span(n), [f, named("arguments", self.arguments(n, f.end, n.args, n.keywords))])

    def of_Lambda(self, n) -> Node:
        own, body = self.parameters(n.args), self.node(n.body, "body")
        return Node("lambda", *self.span(n), [Node("lambda_parameters", own[0].start, own[-1].end, own, "parameters") if own else None, body])

    def of_BoolOp(self, n) -> Node:
        out = self.node(n.values[0])
        for x in n.values[1:]:
            right = self.node(x, "right")
            out = Node("boolean_operator", out.start, right.end, [named("left", out), right])
        return out

    def of_UnaryOp(self, n) -> Node:
        out = self.plain(n)
        out.kind = "not_operator" if isinstance(n.op, ast.Not) else "unary_operator"
        return out

    def of_Constant(self, n) -> Node:
        v = n.value
        kind = {True: "true", False: "false"}[v] if isinstance(v, bool) else "none" if v is None else "ellipsis" if v is ... else "integer" if isinstance(v, int) else "float" if isinstance(v, (float, complex)) else "string"
        return Node(kind, *self.span(n))

    def of_Dict(self, n) -> Node:
        own = []
        for k, v in zip(n.keys, n.values, strict=True):
            value = self.node(v)
            own.append(Node("dictionary_splat", value.start - 2, value.end, [value]) if k is None else Node("pair", self.span(k)[0], value.end, [self.node(k, "key"), named("value", value)]))
        return Node("dictionary", *self.span(n), own)

    def of_If(self, n) -> Node:
        own, rest = [self.node(n.test, "condition"), self.block(n.body, "consequence")], n.orelse
        while rest:
            after = rest[0]
            if len(rest) == 1 and isinstance(after, ast.If) and self.data[self.span(after)[0] :].startswith(b"elif"):
                own.append(self.clause("elif_clause", after.body, [self.node(after.test, "condition")], "alternative", "consequence"))
                rest = after.orelse
            else:
                own.append(self.clause("else_clause", rest, name="alternative"))
                break
        return Node("if_statement", *self.span(n), own)

    def of_With(self, n) -> Node:
        items = []
        for x in n.items:
            value = self.node(x.context_expr)
            to = self.node(x.optional_vars) if x.optional_vars else None
            items.append(Node("with_item", value.start, (to or value).end, [named("value", value), to]))
        return Node("with_statement", *self.span(n), [Node("with_clause", items[0].start, items[-1].end, items), self.block(n.body)])

    of_AsyncWith = of_With

    def of_Try(self, n) -> Node:
        own = [self.block(n.body)]
        for h in n.handlers:
            s, e = self.span(h)
            own.append(Node("except_clause", s, e, [self.node(h.type) if h.type else None, self.block(h.body)]))
        own += [self.clause("else_clause", n.orelse)] if n.orelse else []
        own += [self.clause("finally_clause", n.finalbody)] if n.finalbody else []
        return Node("try_statement", *self.span(n), own)

    of_TryStar = of_Try

    def dotted(self, a: ast.alias) -> Node:
        s, e = self.span(a)
        if a.name == "*":
            return Node("wildcard_import", s, e)
        out = Node("dotted_name", s, s + len(a.name.encode()))
        return Node("aliased_import", s, e, [named("name", out), Node("identifier", e - len(a.asname.encode()), e, field="alias")], "name") if a.asname else named("name", out)

    def of_Import(self, n) -> Node:
        return Node("import_statement", *self.span(n), [self.dotted(a) for a in n.names])

    def of_ImportFrom(self, n) -> Node:
        s, e = self.span(n)
        at = self.data.index(b"from", s) + 4
        at += len(self.data[at:]) - len(self.data[at:].lstrip())
        return Node("import_from_statement", s, e, [Node("dotted_name", at, at + n.level + len((n.module or "").encode()), field="module_name"), *(self.dotted(a) for a in n.names)])

    def of_match_case(self, n) -> Node:
        body = self.block(n.body, "consequence")
        s, e = self.span(n.pattern)
        return Node("case_clause", s, body.end, [Node("case_pattern", s, e), body])

    def of_Match(self, n) -> Node:
        return Node("match_statement", *self.span(n), [self.node(n.subject, "subject"), *(self.of_match_case(c) for c in n.cases)])


def python_tree(source: str) -> Node:
    return PythonTree(source).node(ast.parse(source))


#: A language's reader, from a source to its root, and the kinds that patterns may name.
TREES = {"python": (python_tree, {k for k, _ in KINDS.values()} | set(MADE))}


def numbered(root: Node, data: bytes) -> Iterator[tuple]:
    """Rows of a tree without the path, in pre-order; no recursion, as trees may be deep."""
    feeds = [m.start() for m in re.finditer(b"\n", data)]
    from bisect import bisect_left

    order: list[list] = []
    todo: list[tuple] = [(root, None, 0, True, [])]
    post = 0
    while todo:
        node, parent, place, last, above = todo.pop()
        if node is None:  # all below it are done
            order[parent][1] = post
            post += 1
            continue
        pre = len(order)
        text = None if node.children else data[node.start : node.end].decode("utf-8", "replace")
        order.append([pre, 0, parent, place, last, above, node.kind, node.field, node.start, node.end, bisect_left(feeds, node.start), bisect_left(feeds, node.end), text])
        todo.append((None, pre, 0, False, above))
        inner = [*above, pre]
        todo += [(c, pre, k, k == len(node.children) - 1, inner) for k, c in reversed(list(enumerate(node.children)))]
    return map(tuple, order)


def trees(sources: DataFrame, language: str = "python") -> DataFrame:
    """The node table of (path, content). A null, or a source that can't be read, has no nodes; extra columns are left out."""
    if language not in TREES:
        raise ValueError(f"no trees for the language {language!r}")
    read = TREES[language][0]
    fields = [x.split() for x in NODE.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(n, kinds[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = list(numbered(read(content), content.encode())) if content is not None else []
                except (SyntaxError, ValueError, RecursionError, tokenize.TokenError, IndexError):
                    rows = []
                for s in range(0, len(rows), 20_000):
                    part = rows[s : s + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), *(pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types[1:], strict=True))], schema=schema)

    return spread_rows(sources.select("path", "content"), "path").mapInArrow(run, NODE)


# ---------------------------------------------------------------- patterns


@dataclass(frozen=True)
class Pattern:
    """A node of a pattern. ``kind`` None: any; ``alternatives``: any of these, which have their own children."""

    kind: str | None = None
    field: str | None = None
    captures: tuple[str, ...] = ()
    children: tuple[Pattern, ...] = ()
    absent: tuple[str, ...] = ()
    alternatives: tuple[Pattern, ...] = ()
    many: str = ""
    deep: bool = False
    first: bool = False
    after: bool = False  # right behind the child before
    last: bool = False
    predicates: tuple[tuple[str, ...], ...] = ()


TOKEN = re.compile(r'\s+|;[^\n]*|(?P<t>>>|[()\[\].?*+]|"(?:[^"\\]|\\.)*"|@[\w.-]+|#[\w-]+[?!]|[A-Za-z_][\w-]*\s*:|!?[A-Za-z_][\w-]*)')


def parsed(query: str, kinds: set[str] | None = None) -> list[Pattern]:
    """The patterns of a query; ValueError if it isn't one."""
    tokens, at = [], 0
    while at < len(query):
        m = TOKEN.match(query, at)
        if not m:
            raise ValueError(f"not a tree query at {query[at : at + 20]!r}")
        if m["t"]:
            tokens.append(m["t"])
        at = m.end()
    k = 0

    def peek() -> str:
        return tokens[k] if k < len(tokens) else ""

    def take(want: str = "") -> str:
        nonlocal k
        if k >= len(tokens) or (want and tokens[k] != want):
            raise ValueError(f"tree query: {want or 'more'} expected at token {k}")
        k += 1
        return tokens[k - 1]

    def predicate() -> tuple[str, ...]:
        name, own = take(), []
        while peek() != ")":
            t = take()
            own.append(t if t[0] == "@" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1] if m[1] in '"\\' else m[0]), t[1:-1]) if t[0] == '"' else t)
        take(")")
        if name not in COMPARE or not own or own[0][0] != "@":
            raise ValueError(f"unknown predicate {name}")
        return (name, *own)

    def children(end: str) -> tuple[tuple[Pattern, ...], tuple, tuple]:
        out, absent, checks, anchor, any_anchor = [], [], [], False, False
        while peek() != end:
            if peek() == ".":
                take()
                anchor = any_anchor = True
            elif peek()[:1] == "!":
                absent.append(take()[1:])
            elif peek() == "(" and k + 1 < len(tokens) and tokens[k + 1][0] == "#":
                take("(")
                checks.append(predicate())
            else:
                one = element()
                out.append(replace(one, first=anchor and not out, after=anchor and bool(out)))
                anchor = False
        take(end)
        if anchor and any_anchor and out:
            out[-1] = replace(out[-1], last=True)
        return tuple(out), tuple(absent), tuple(checks)

    def element() -> Pattern:
        deep = peek() == ">>"
        if deep:
            take()
        name = take()[:-1].strip() if peek().endswith(":") and peek()[0] != '"' else None
        t = take()
        if t == "(":
            if peek() in ("(", "["):  # siblings, or one pattern with its predicates
                own, absent, checks = children(")")
                if len(own) == 1:
                    one = replace(own[0], predicates=own[0].predicates + checks)
                else:
                    one = Pattern(children=own, absent=absent, predicates=checks)
            else:
                kind = take()
                if not re.fullmatch(r"[A-Za-z_][\w-]*", kind):
                    raise ValueError(f"a kind expected, not {kind!r}")
                if kind != "_" and kinds is not None and kind not in kinds:
                    raise ValueError(f"unknown kind {kind!r}")
                own, absent, checks = children(")")
                one = Pattern(None if kind == "_" else kind, None, (), own, absent, predicates=checks)
        elif t == "[":
            own, _, checks = children("]")
            if not own:
                raise ValueError("no alternatives")
            one = Pattern(alternatives=tuple(replace(x, first=False, after=False) for x in own), predicates=checks)
        elif t == "_":
            one = Pattern()
        else:
            raise ValueError(f"unnamed nodes aren't in the trees: {t}")
        many = take() if peek() in ("?", "*", "+") and peek() else ""
        captures = []
        while peek()[:1] == "@":
            captures.append(take()[1:])
        return replace(one, field=name, captures=one.captures + tuple(captures), many=many, deep=deep)

    out: list[Pattern] = []
    while k < len(tokens):
        if peek() == "(" and k + 1 < len(tokens) and tokens[k + 1][0] == "#" and out:
            take("(")
            out[-1] = replace(out[-1], predicates=out[-1].predicates + (predicate(),))
        else:
            out.append(element())
    if not out:
        raise ValueError("an empty tree query")
    return out


def spread(p: Pattern) -> list[Pattern]:
    """The pattern without alternatives: one for each choice. Those that differ in their kind only stay together, by a joined name."""
    if p.alternatives:
        if all(not (a.children or a.absent or a.captures or a.predicates or a.alternatives or a.many or a.field) and a.kind for a in p.alternatives):
            return spread(replace(p, kind="|".join(a.kind for a in p.alternatives), alternatives=()))
        own = {"field": p.field, "many": p.many, "deep": p.deep, "first": p.first, "after": p.after, "last": p.last}
        return [y for a in p.alternatives for y in spread(replace(a, captures=a.captures + p.captures, predicates=a.predicates + p.predicates, **{**own, "field": p.field or a.field}))]
    return [replace(p, children=c) for c in product(*map(spread, p.children))]


COMPARE = {
    "#eq?": lambda a, *b: a == b[0], "#not-eq?": lambda a, *b: a != b[0], "#match?": lambda a, *b: a.rlike(b[0]), "#not-match?": lambda a, *b: ~a.rlike(b[0]),
    "#any-of?": lambda a, *b: a.isin(*b), "#not-any-of?": lambda a, *b: ~a.isin(*b),
}


class Matcher:
    """One pattern without alternatives as a plan over a node table."""

    def __init__(self, tree: DataFrame, sources: DataFrame | None, pattern: Pattern) -> None:
        self.tree, self.sources, self.n = tree, sources, 0
        self.captured: list[tuple[str, int, bool]] = []  # name, pattern node, whether under a quantifier
        self.fixed: list[int] = []
        checks = self.checks_of(pattern)
        self.early = [c for c in checks if not any(x[0] == "@" for x in c[2:])]
        self.late = [c for c in checks if c not in self.early]
        self.pushed: list[tuple] = []
        self.plan = self.matched(pattern, False)[0]

    def checks_of(self, p: Pattern) -> list[tuple]:
        return [*p.predicates, *(x for c in p.children for x in self.checks_of(c))]

    def matched(self, p: Pattern, loose: bool) -> tuple[DataFrame, int]:
        """Rows with path and, for each pattern node k, n{k} (its pre) and what is needed of it."""
        k, self.n = self.n, self.n + 1
        loose = loose or p.many in ("*", "+")
        if not loose:
            self.fixed.append(k)
        rows = self.tree
        if p.kind:
            rows = rows.filter(F.col("kind").isin(*p.kind.split("|")))
        if p.field:
            rows = rows.filter(F.col("field") == p.field)
        if p.first:
            rows = rows.filter("place = 0")
        if p.last:
            rows = rows.filter("is_last")
        for c in self.early:
            if c[1][1:] in p.captures and p.kind and set(p.kind.split("|")) <= LEAVES and not loose:
                rows = rows.filter(COMPARE[c[0]](F.col("text"), *c[2:]))
                self.pushed.append((c, k))
        keep = [F.col("path"), F.col("pre").alias(f"n{k}"), F.col("parent").alias(f"u{k}"), F.col("place").alias(f"i{k}")]
        if p.captures:
            self.captured += [(name, k, loose) for name in p.captures]
            keep.append(F.struct("start_line", "end_line", "start_byte", "end_byte", "text").alias(f"c{k}"))
        if p.deep:
            keep.append(F.explode("above").alias(f"a{k}"))
        out = rows.select(*keep)
        for name in p.absent:
            gone = self.tree.filter(F.col("field") == name).select(F.col("path").alias("_p"), F.col("parent").alias("_u")).distinct()
            out = out.join(shuffled(gone), (F.col("path") == F.col("_p")) & (F.col(f"n{k}") == F.col("_u")), "left_anti")
        before = None
        for c in p.children:
            inner, j = self.matched(c, loose)
            inner = inner.withColumnRenamed("path", "_p")
            on: Column = (F.col("path") == F.col("_p")) & (F.col(f"n{k}") == F.col(f"a{j}" if c.deep else f"u{j}"))
            if before is not None and not c.deep:
                on = on & (F.coalesce(F.col(f"i{before}"), F.lit(-1)) < F.col(f"i{j}"))
                if c.after:
                    on = on & (F.col(f"i{before}") + 1 == F.col(f"i{j}"))
            out = out.join(shuffled(inner), on, "left" if c.many in ("?", "*") else "inner").drop("_p", f"u{j}", f"a{j}")
            before = before if c.deep else j
        return out.drop(*[f"i{j}" for j in range(k + 1, self.n)]), k

    def rows(self, number: int) -> DataFrame:
        """Captures of all matches; a match is told by its root and the nodes outside of ``*`` and ``+``."""
        out = self.plan.drop("u0", "i0")
        if self.sources is not None and (self.captured or self.late):
            wanted = self.sources.select(F.col("path").alias("_p"), F.encode("content", "UTF-8").alias("_b"))
            out = out.join(shuffled(wanted), F.col("path") == F.col("_p"))
            for k in {k for _, k, _ in self.captured}:
                c = F.col(f"c{k}")
                text = F.coalesce(c["text"], F.decode(F.substring(F.col("_b"), c["start_byte"] + 1, c["end_byte"] - c["start_byte"]), "UTF-8"))
                out = out.withColumn(f"c{k}", F.when(c.isNotNull(), c.withField("text", text)))
            out = out.drop("_p", "_b")
        by_name = {name: f"c{k}" for name, k, _ in self.captured}
        for c in [c for c in self.early + self.late if not any(c == done for done, _ in self.pushed)]:
            for x in [c[1], *c[2:]]:
                if x[0:1] == "@" and x[1:] not in by_name:
                    raise ValueError(f"no capture {x}")
            values = [F.col(by_name[x[1:]])["text"] if x[:1] == "@" and x[1:] in by_name else x for x in c[2:]]
            out = out.filter(F.col(by_name[c[1][1:]]).isNull() | COMPARE[c[0]](F.col(by_name[c[1][1:]])["text"], *values))
        match = F.array(*[F.col(f"n{k}") for k in self.fixed])
        every = [F.struct(F.lit(name).alias("capture"), F.col(f"n{k}").alias("node"), F.col(f"c{k}").alias("at")) for name, k, _ in self.captured]
        if not every:
            return out.sparkSession.createDataFrame([], MATCH)
        out = out.select("path", F.lit(number).alias("pattern"), match.alias("match"), F.explode(F.filter(F.array(*every), lambda e: e["node"].isNotNull())).alias("e"))
        out = out.select("path", "pattern", "match", "e.capture", "e.node", F.col("e.at.text").alias("text"), *[F.col(f"e.at.{c}").alias(c) for c in ("start_line", "end_line", "start_byte", "end_byte")])
        return out.dropDuplicates(["path", "pattern", "match", "capture", "node"]) if any(loose for *_, loose in self.captured) else out


MATCH = "path string, pattern int, match array<int>, capture string, node int, text string, start_line int, end_line int, start_byte int, end_byte int"


def matches(tree: DataFrame, query: str, sources: DataFrame | None = None, kinds: set[str] | None = None) -> DataFrame:
    """All captures of a query over a node table: (path, pattern, match, capture, node, text, lines from 0, bytes). ``sources`` (path, content) gives the text of nodes with children."""
    out = None
    for number, p in enumerate(parsed(query, kinds)):
        for one in spread(p):
            own = Matcher(tree, sources, one).rows(number)
            out = own if out is None else out.unionByName(own)
    return out


def captures(sources: DataFrame, query: str, language: str = "python") -> DataFrame:
    """Captures of a tree query over (path, content). Each source is read once: the node table is written before it is joined."""
    if language not in TREES:
        raise ValueError(f"no trees for the language {language!r}")
    parsed(query, TREES[language][1])
    return matches(checkpointed(trees(sources, language)), query, sources, TREES[language][1])
