"""Definition and use sites of names in languages with brackets, and the declaration that each is bound to.

The kind of a site is told by the tokens beside it: ``write`` where a name is declared with a value or assigned, ``write_read`` where it is counted up or, in
languages that say so, assigned together with an operator, else ``read``; so a place is never both, and the anti join of reads and writes at one place is part of
the rule. Members behind a dot or arrow (Java's but for those), keys of literals and methods of TypeScript, fields of structs and classes of Go, C and C++ are no sites; the name behind ``::`` or of a field is one without a declaration.

A declaration holds from its place (in Rust and Go from the end of its statement) to the end of its scope: the pair around it, the body behind a header,
the body of a function for its parameters, an expression for those of a lambda. Scopes of a name nest, so a site is bound to the last start at its level of
nesting: one pass over the starts of the scopes of a (file, name), no join of sites with scopes. All of it is told file by file, where the tokens are made; only sites leave the task. Names that patterns of Rust take apart, and an ``else`` behind a header,
are outside of what is told here: the first have no declaration, the second sees what was declared before the header. A pointer of C declared with a value counts as written.
A name in the place of a type is a read. A null source has no sites.
"""

from __future__ import annotations

import marshal
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import tokens as K
from lodestone.operators.tokens import LAST
from lodestone.session import checkpointed

SITE = "kind string, symbol string, line int, column int, enclosing_scope string, declared_line int"
#: Languages whose sites are told.
LANGUAGES = ("rust", "go", "java", "typescript", "c", "cpp")
# Words that are types, words before a header in round brackets, operators that assign.
TYPES = frozenset("auto bool boolean byte char const double final float int long short signed static unsigned void".split())
HEADERS = frozenset(("for", "while", "if", "switch", "catch", "try"))
COMPOUND = frozenset(("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "**=", "&&=", "||=", "??=", "&^="))
COUNTED = ("++", "--")
_LISTED = frozenset(", . * [ ] ( )".split())
_BLOCKS = ("if", "for", "while", "switch", "match", "{", "}")
_CLASSES = ("class", "interface", "enum", "record")


class _Names:
    """What the rules look at, of the names in ``symbols`` (None: all) of one file.

    Ahead of a token in its own pair: ``ends``, the first token that is part of no list of names, ``cut`` (, or ;), ``semi``, ``brace`` and ``next_line``, the first token of a later line; behind it: ``begins``, the
    last token that is no name or comma, and ``header``, whether it stands behind a header without brackets. -1 where there is none.
    """

    def __init__(self, f: K.Nesting, symbols: frozenset[str] | None) -> None:
        self.f = f
        self.at = [i for i, kind in enumerate(f.kinds) if kind == "name" and (symbols is None or f.texts[i] in symbols)]
        if not self.at:
            return
        candidates = f.candidates()
        self.bodies = f.bodies(candidates)
        # Round brackets that hold parameters, right behind a declared name or its type arguments, and where the function ends.
        self.params: dict[int, int | None] = {}
        for x in candidates:
            if x.declared:
                start = x.i + 1
                if f.text(start) == "<" and f.kinds[start] == "open":
                    start = f.close[start] + 1
                self.params[start] = x.close if x.end is None else x.end
        wanted = {*self.at, *f.opener}
        self.ends, self.cut, self.semi, self.brace, self.next_line, self.begins, self.header = ({} for _ in range(7))
        self._ahead(wanted)
        if f.language in ("go", "rust"):
            self._behind(wanted)

    def _ahead(self, wanted: set[int]) -> None:
        f = self.f
        ends, cut, semi, brace, line, first, later = ({} for _ in range(7))
        for i in range(f.n - 1, -1, -1):
            g, text, kind, at = f.group[i], f.texts[i], f.kinds[i], f.lines[i]
            if line.get(g) != at:
                line[g], later[g] = at, first.get(g, -1)
            first[g] = i
            if i in wanted:
                self.ends[i], self.cut[i], self.semi[i], self.brace[i], self.next_line[i] = ends.get(g, -1), cut.get(g, -1), semi.get(g, -1), brace.get(g, -1), later[g]
            if kind == "name":
                continue
            if text not in _LISTED:
                ends[g] = i
            if text == ";":
                cut[g] = semi[g] = i
            elif text == ",":
                cut[g] = i
            elif text == "{" and kind == "open":
                brace[g] = i

    def _behind(self, wanted: set[int]) -> None:
        f, begins, block = self.f, {}, {}
        for i, (g, text, kind) in enumerate(zip(f.group, f.texts, f.kinds, strict=True)):
            if i in wanted:
                self.begins[i], self.header[i] = begins.get(g), block.get(g) in ("if", "for", "while", "switch")
            if kind != "name" and text != ",":
                begins[g] = text
            if text in _BLOCKS:
                block[g] = text

    def sites(self) -> Iterator[tuple[int, str, bool, bool, bool, tuple[int, int] | None]]:
        """(place, access, whether it is declared there, whether it is bound to nothing, whether it is left out, (start, end) of the scope of the declaration) of each site."""
        f, language = self.f, self.f.language
        rust, go, java, typescript, c, cpp = (language == x for x in LANGUAGES)
        for i in self.at:
            t1, t2, t3, follows = f.text(i - 1), f.text(i - 2), f.text(i - 3), f.text(i + 1)
            k1, new_line = (f.kinds[i - 1], f.lines[i - 1] != f.lines[i]) if i else (None, False)
            pair = f.group[i] if f.group[i] >= 0 else None
            bracket, head, before, after, stop = ("", "", "", None, -1) if pair is None else (f.texts[pair], f.head[pair], f.text(pair - 1) or "", f.behind(pair), f.stop_of(pair))
            member = not java and (t1 == "." or (t1 == "->" and not rust))
            key = follows == ":" and bracket == "{" and t1 in ("{", ",") and (rust or typescript)
            method = (typescript and head == "class" and follows == "(") or (go and before in ("struct", "interface"))
            if member or key or method:
                continue
            param, free, in_class = pair in self.params, t1 not in (".", "->", "::"), head in _CLASSES
            round_ = bracket == "("
            held = (typescript and round_ and after == "=>") or (java and round_ and after == "->") or (rust and bracket == "|") or (go and round_ and before == "func") or (cpp and round_ and before == "]" and after in ("{", "->", "mutable"))
            single = (typescript and follows == "=>") or (java and follows == "->" and t1 is not None and t1 not in ("case", ","))
            params, header = param or held, self.header.get(i, False)
            assigned = follows == "=" and free and not param
            # Types stand before a declared name; before those, the begin of a statement or parameter.
            simple = k1 == "name" or t1 in TYPES or (k1 == "close" and t1 in (">", "]"))
            pointer = t1 in ("*", "&") and (t3 is None or t3 in (";", "{", "}", "(", ",", "const", "static", "struct"))
            typed = (simple or pointer) and follows in ("=", ";", ",", "[", ")", ":", "{")
            in_code = bracket == "{" and before not in ("=", "]", ",", "(")
            more = in_code and t1 == "," and follows in (",", ";", "=")
            is_header = round_ and before in HEADERS
            compound, counts, untyped = follows in COMPOUND and free, follows in COUNTED, t1 in ("(", ",", "...", "|", "mut", "&")
            counted = (counts or (t1 in COUNTED and not new_line)) and free
            members = simple and bracket == "{" and head in ("class", "struct", "enum", "record", "interface") and follows in ("=", ";", ",")
            field = typescript and head == "class" and bracket == "{" and follows in ("=", ":", ";", "?", "!")
            if rust:
                let = t1 == "let" or (t1 == "mut" and t2 == "let")
                write = let or (assigned and bracket != "<" and t1 is not None and t1 not in ("type", "const", "static"))
                both = compound
                binds = let or (t1 == "for" and follows == "in") or (param and follows == ":" and untyped) or (held and untyped)
            elif go:
                ends = self.ends[i]
                first = t1 is None or new_line or t1 in (",", ";", "{", "}", "if", "for", "switch", "case", "else", ":")
                left = first and free and follows in (",", ":=", "=") and ends >= 0 and f.lines[ends] == f.lines[i]
                var = t1 == "var" or (t1 == "," and self.begins[i] == "var") or (round_ and before == "var" and (t1 == "(" or new_line))
                write = (left and f.texts[ends] in (":=", "=") and f.text(ends + 1) not in ("range", None)) or compound or var
                both = counts and free
                named = follows in (",", "*", "[", "func", "map", "chan", "...", "interface", "struct") or (i + 1 < f.n and f.kinds[i + 1] == "name")
                binds = (left and f.texts[ends] == ":=") or var or (params and t1 in ("(", ",") and named)
            elif java:
                local = typed and (in_code or is_header) and not in_class
                write = (local and follows != ":" and before != "try") or (assigned and not in_class and before != "try") or compound or (more and not in_class)
                both = counted
                binds = local or more or members or (param and typed) or (held and (typed or untyped)) or single
            elif typescript:
                words = t1 in ("let", "const", "var")
                taken = before in ("let", "const", "var") and ((bracket == "{" and (follows in (",", "}", "=") or t1 == ":")) or (bracket == "[" and t1 in ("[", ",")))
                write = (words and follows not in ("of", "in")) or taken or (assigned and not held) or field
                both = counted or compound
                binds = words or taken or (params and untyped and follows in (":", ",", ")", "=", "?")) or single
            else:
                write = (assigned and (t1 != "*" or pointer)) or compound
                both = counted
                inner = in_code and head not in (("struct", "union", "enum") if c else ("class", "struct", "union", "enum"))
                binds = (typed and (inner or is_header or (param if c else params) or f.depth[i] == 0)) or more or (cpp and members)
            scope = self._scope(i, pair, param, held, single, is_header, header, (java or cpp) and members, after, stop) if binds else None
            yield i, "write_read" if both else "write" if write else "read", binds, t1 in (".", "::") or field, (c and simple and head in ("struct", "union")) or (cpp and members), scope

    def _scope(self, i: int, pair: int | None, param: bool, held: bool, single: bool, is_header: bool, header: bool, member: bool, after: str | None, stop: int) -> tuple[int, int] | None:
        """(start, end) of where the declaration at i holds: the body behind it, a limit of its kind, or the end of the pair around it."""
        f = self.f
        rust, go = f.language == "rust", f.language == "go"
        closed = pair is not None and f.close[pair] != LAST
        end = f.close[pair] if closed else None
        outer = self._outer(end) if closed else None
        none, body, limit = -1, -1, None
        if param:
            limit = self.params[pair]
        elif held:
            brace = self.brace[end] if closed else none
            limit = self.cut[end] if closed and self.cut[end] >= 0 else outer
            if go or f.language == "cpp":
                body = stop
            elif closed and brace == end + (1 if rust else 2):
                body = brace
        elif single:
            body = self.brace[i] if self.brace[i] == i + 2 else none
            limit = self.cut[i] if self.cut[i] >= 0 else None
        elif is_header:
            body = stop if after == "{" or (stop >= 0 and f.texts[stop] == "{") else none
            limit = stop if stop >= 0 else outer
        elif header:
            body = self.brace[i]
        if (rust or go) and not param and not held:
            if rust:
                start = self.brace[i] if header else self.semi[i]
            else:
                start = min((x for x in (self.semi[i], self.next_line[i], self.brace[i] if header else none) if x >= 0), default=none)
            start = start if start >= 0 else i
        else:
            start = pair if member and pair is not None else i
        if body >= 0 and f.texts[body] == "{":
            end = f.close[body]
        elif limit is not None:
            end = limit
        elif not closed:
            end = LAST
        return (start, end) if start < end else None

    def _outer(self, end: int) -> int:
        """The end of the pair around a pair that ends at ``end``."""
        around = self.f.group[end]
        return self.f.close[around] if around >= 0 else LAST


def sites_of(content: str, language: str, symbols: frozenset[str] | None = None) -> list[tuple]:
    """(kind, symbol, line, column, enclosing scope, declared line) of the names of a source, of ``symbols`` only if given."""
    if symbols is not None and not any(x in content for x in symbols):
        return []
    f = K.Nesting(content, language)
    names = _Names(f, symbols)
    found = list(names.sites()) if names.at else []
    if not found:
        return []
    scopes: dict[str, list[tuple[int, int, int]]] = {}
    places: dict[str, list[int]] = {}
    for i, *_, scope in found:
        places.setdefault(f.texts[i], []).append(i)
        if scope:
            scopes.setdefault(f.texts[i], []).append((*scope, f.lines[i]))
    bound: dict[int, int | None] = {}
    for symbol, own in places.items():
        bound.update(zip(own, K.innermost(own, sorted(scopes.get(symbol, []), key=lambda x: x[0])), strict=True))
    around = K.innermost([x[0] for x in found], names.bodies)
    return [(access, f.texts[i], f.lines[i], f.cols[i], scope or K.MODULE, None if apart else f.lines[i] if binds else bound[i]) for (i, access, binds, apart, hidden, _), scope in zip(found, around, strict=True) if not hidden]


def sites(sources: DataFrame, symbols: list[str] | None = None, spread: bool = True) -> DataFrame:
    """(path, kind, symbol, line, column, enclosing_scope, declared_line) of the names in (path, content), of ``symbols`` only if given.

    ``enclosing_scope`` is the innermost function around a site, ``declared_line`` the line of the declaration it is bound to, null where none is in the file.
    """
    wanted = None if symbols is None else frozenset(symbols)
    return K.read(sources, SITE, lambda content, language: sites_of(content, language, wanted), spread, LANGUAGES)


def by_path(df: DataFrame) -> DataFrame:
    """``df`` in ranges of path, each in order and as many as a shuffle has tasks."""
    spark = df.sparkSession
    return df.repartitionByRange(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "path").sortWithinPartitions("path")


def def_use(sources: DataFrame, symbol: str, ranged: bool = False) -> DataFrame:
    """Sites of one symbol, writes first, then by file, line and column, with their place ``ord`` in this order. A place is never a read and a write.

    Files are put in order before they are read (``ranged``: they already are), so sites come in order; those of a file are one packed row until the counts of all ranges are known.
    """
    wanted = frozenset((symbol,))

    def pack(content: str, language: str) -> list[tuple]:
        found = [(line, column, kind, scope, own) for kind, _, line, column, scope, own in sites_of(content, language, wanted)]
        reads = sum(x[2] == "read" for x in found)
        return [(len(found) - reads, reads, zlib.compress(marshal.dumps(found), 1))] if found else []

    held = checkpointed(K.read(sources if ranged else by_path(sources), "writes int, reads int, packed binary", pack, False, LANGUAGES))
    held = held.withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33))
    counts = held.groupBy("_part").agg(F.sum("writes").alias("w"), F.sum("reads").alias("r"))  # one row a range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("w").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    counts = counts.select("_part", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w"), (total + F.coalesce(F.sum("r").over(before), F.lit(0))).alias("r"))
    fields = [("path", pa.string()), *((x.split()[0], K.ARROW[x.split()[1]]) for x in SITE.split(", ")), ("ord", pa.int64())]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])
        files = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("_part", "path", "packed", "w", "r")), strict=True))
        out: list[tuple] = []
        for _, range_ in groupby(files, lambda x: x[0]):
            writes = reads = 0
            for path, same in groupby(range_, lambda x: x[1]):
                same = list(same)
                *_, w, r = same[0]
                for line, column, kind, scope, own in sorted((y for x in same for y in marshal.loads(zlib.decompress(x[2]))), key=lambda y: y[:2]):
                    if kind == "read":
                        reads += 1
                    else:
                        writes += 1
                    out.append((path, kind, symbol, line, column, scope, own, r + reads if kind == "read" else w + writes))
                    if len(out) >= 20_000:
                        yield made(out)
                        out = []
        if out:
            yield made(out)

    return held.join(F.broadcast(counts), "_part").select("_part", "path", "packed", "w", "r").mapInArrow(unpack, f"path string, {SITE}, ord long")
