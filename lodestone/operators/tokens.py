"""Calls, functions and type references of languages with brackets, from a token table.

``tokens`` cuts each source into its tokens, comments left out, one regular expression a language. Type references take the token table as rows: brackets are matched there
by running sums, as a bracket opens at the depth of all that are open before it, and the n-th that opens at a depth closes with the n-th that closes there.

Calls and functions are read file by file, where the tokens are made (``Nesting``): no token leaves its task, only the rows that are asked for do, so neither disk nor shuffles
grow with the tokens. Brackets are matched there by a table of what is open at each depth, which is the same rule. Arguments are the commas right inside a pair; the body of a
function is the first ``{`` after its arguments before a ``;`` on the same depth; the innermost function around a call is the last begun of those that go on.

A call is a name before ``(`` that is no keyword and not declared there: what a declaration looks like is told for each language by the tokens beside
it. As in the usual grammars, macros and what is inside them, patterns, annotations, ``new``, qualified names of C++ and names with type arguments are no calls.
A task holds the tokens of one file, whose size sources limit. A null source has no tokens; unclosed brackets end with their file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import language_label
from lodestone.session import shuffled, spread_rows

TOKEN = "path string, language string, i int, kind string, text string, line int, col int"
ARROW = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
MODULE = "<module>"
#: The end of what is never closed.
LAST = 2**31 - 1

# Comments and strings of each language, and its keywords that stand before a bracket or a name.
_C_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_STRING = r'"(?:[^"\\\n]|\\[\s\S])*"?'
_CHAR = r"'(?:[^'\\\n]|\\[\s\S])*'?"
LEXICON: dict[str, tuple[str, str]] = {
    "rust": (_C_COMMENT + r"|\#!?\[[^\]\n]*\]", r'b?r(?P<h>\#*)"[\s\S]*?"(?P=h)|b?"(?:[^"\\]|\\[\s\S])*"?|' + r"b?'(?:[^'\\\n]|\\[^\n]{1,8}?)'|'\w+"),
    "go": (_C_COMMENT, _STRING + r"|`[^`]*`?|" + _CHAR),
    "java": (_C_COMMENT, r'"""[\s\S]*?"""|' + _STRING + "|" + _CHAR),
    "typescript": (_C_COMMENT, _STRING + "|" + _CHAR + r"|`(?:[^`\\]|\\[\s\S])*`?"),
    "c": (_C_COMMENT + r"|^[ \t]*\#(?:[^\n\\]|\\[\s\S])*", _STRING + "|" + _CHAR),
    "cpp": (_C_COMMENT + r"|^[ \t]*\#(?:[^\n\\]|\\[\s\S])*", r'R"(?P<h>[^()\s]*)\([\s\S]*?\)(?P=h)"|' + _STRING + "|" + _CHAR),
    "fortran": (r"![^\n]*|&[ \t]*(?=\n)", r'"[^"\n]*"?|' + r"'[^'\n]*'?"),
}
KEYWORDS: dict[str, str] = {
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static super switch synchronized this throw throws transient try void volatile while yield record",
    "typescript": "abstract as async await break case catch class const continue debugger default delete do else enum export extends finally for from function get if implements import in instanceof interface let new of private protected public readonly return set static super switch this throw try type typeof var void while yield",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register return short signed sizeof static struct switch typedef union unsigned void volatile while",
    "cpp": "alignof auto bool break case catch char class const constexpr continue decltype default delete do double else enum explicit extern final float for friend goto if inline int long namespace new noexcept operator override private protected public register return short signed sizeof static static_cast struct switch template this throw try typedef typename union unsigned using virtual void volatile while",
    "fortran": "allocate associate call case character class close complex contains deallocate dimension do double else elseif end enddo endif exit forall format function if implicit in inout inquire integer intent kind len logical module none open optional out parameter pointer precision print private procedure program public pure read real recursive result return rewind select stop subroutine target then type use where while write",
}
#: Keywords after which a name before ``(`` is called although a name is declared after others.
CALLS_AFTER = "return else case throw yield await do in of typeof delete not and or when assert goto co_return co_yield co_await default defer go match if while move unsafe break loop instanceof then call"


@cache
def _lexicon(language: str) -> tuple[re.Pattern, re.Pattern, frozenset[str]]:
    """(one token, type arguments before a bracket, keywords)."""
    comment, string = LEXICON[language]
    one = re.compile(rf"(?P<c>{comment})|(?P<s>{string})|(?P<n>\d\w*(?:\.\d\w*)?)|(?P<w>[A-Za-z_$][\w$]*)|(?P<o><<=|>>>?=|\*\*=|&&=|\|\|=|\?\?=|&\^=|&=|\|=|\^=|->|=>|::|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|:=|\+\+|--|\*\*|\.\.\.?|[^\s\w])|(?P<l>\n)", re.M)
    return one, re.compile(r"<[\w\s,.<>\[\]?:']*>\s*\("), frozenset(KEYWORDS[language].split())


def lexed(source: str, language: str) -> list[tuple]:
    """(kind, text, line, column) of the tokens: name, word (a keyword), number, text, open, close, op."""
    folds = language == "fortran"
    one, types, words = _lexicon(language)
    out, line, start, angles, bars, skip = [], 1, 0, 0, 0, False
    for m in one.finditer(source):
        kind, text = m.lastgroup if m.lastgroup != "h" else "s", m[0]
        at = (line, m.start() - start)
        if kind == "l":
            if folds and out and out[-1][:2] == ("word", "end"):
                out[-1] = ("close", "end", *out[-1][2:])
            if folds:
                out.append(("op", "\n", *at))
        elif kind == "s":
            out.append(("text", text, *at))
        elif kind == "n":
            out.append(("number", text, *at))
        elif kind == "w":
            low = text.lower() if folds else text
            before = out[-1] if out else ("", "", 0, 0)
            if folds and low in ("subroutine", "function") and not skip:
                if before[1] == "end":
                    out[-1] = ("word", "end", *before[2:])
                    out.append(("close", low, *at))
                else:
                    out.append(("open", low, *at))
            elif folds and low in ("endsubroutine", "endfunction"):
                out.append(("close", low, *at))
            else:
                out.append(("word" if low in words else "name", low, *at))
        elif kind == "o":
            before = out[-1][1] if out else "{"
            if text == "<" and not folds and out and out[-1][0] in ("name", "op") and types.match(source, m.start()):
                angles += 1
                out.append(("open", "<", *at))
            elif text == ">" and angles:
                angles -= 1
                out.append(("close", ">", *at))
            elif text == "|" and language == "rust" and (bars or before in ("(", ",", "=", "move", "{", "return", "=>", ";", "[", "}")):
                out.append(("close" if bars else "open", "|", *at))
                bars = 1 - bars
            else:
                out.append(("open" if text in "([{" else "close" if text in ")]}" else "op", text, *at))
        feeds = text.count("\n")
        if feeds:
            line += feeds
            start = m.start() + text.rindex("\n") + 1
    return out


def read(sources: DataFrame, schema: str, rows: Callable[[str, str], list[tuple]], spread: bool = True, languages: tuple[str, ...] = tuple(LEXICON)) -> DataFrame:
    """path and the ``schema`` of what ``rows`` finds in (content, language) of (path, content), the language from the path or a column ``language``; only sources of ``languages`` are read.

    With ``spread`` false, ``sources`` are read in the tasks they come in.
    """
    s = sources if "language" in sources.columns else sources.withColumn("language", language_label(F.col("path")))
    own = pa.schema([("path", pa.string()), *((f.split()[0], ARROW[f.split()[1]]) for f in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), own.types, strict=True)], schema=own)
        for batch in batches:
            for path, language, content in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content")), strict=True):
                found = rows(content, language)
                for s in range(0, len(found), 20_000):
                    held += [(path, *row) for row in found[s : s + 20_000]]
                    if len(held) >= 20_000:  # small sources share a batch
                        yield made(held)
                        held = []
        if held:
            yield made(held)

    s = s.select("path", "language", "content").filter(F.col("language").isin(*languages) & F.col("content").isNotNull())
    return (spread_rows(s, "path") if spread else s).mapInArrow(run, f"path string, {schema}")


def tokens(sources: DataFrame) -> DataFrame:
    """The token table of (path, content), the language from the path or a column ``language``; sources of other languages have no tokens."""
    return read(sources, TOKEN.removeprefix("path string, "), lambda content, language: [(language, i, *token) for i, token in enumerate(lexed(content, language))])


def nested(t: DataFrame) -> DataFrame:
    """Tokens with ``depth`` (of what they stand in), the number ``pair`` of the pair around them at that depth, and for brackets ``own_depth`` and ``own_pair``, the pair they are part of."""
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    file = Window.partitionBy("path").orderBy("i")
    upto = F.sum(step).over(file.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("depth", F.when(F.col("kind") == "open", upto - 1).otherwise(upto).cast("int"))
    t = t.withColumns({k: f.over(file) for k, f in {"t1": F.lag("text"), "k1": F.lag("kind"), "t2": F.lag("text", 2), "next": F.lead("text"), "next_kind": F.lead("kind")}.items()})
    opens = F.sum(F.when(F.col("kind") == "open", 1).otherwise(0)).over(Window.partitionBy("path", "depth").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    bracket = F.col("kind").isin("open", "close")
    return t.withColumn("own_depth", F.when(bracket, F.col("depth"))).withColumn("own_pair", F.when(bracket, opens))


def pairs_of(t: DataFrame) -> DataFrame:
    """(path, depth, pair, start, end, text): the matched brackets; an unclosed one ends with its file."""
    b = t.filter("own_pair is not null").groupBy("path", "own_depth", "own_pair")
    return b.agg(F.min(F.when(F.col("kind") == "open", F.col("i"))).alias("start"), F.min(F.when(F.col("kind") == "close", F.col("i"))).alias("end"), F.first(F.when(F.col("kind") == "open", F.col("text")), ignorenulls=True).alias("bracket")).filter("start is not null").withColumn("end", F.coalesce("end", F.lit(2**31 - 1)))


def inside_of(t: DataFrame) -> DataFrame:
    """``t`` with ``around``, the pair at depth - 1 that a token is in: the last that opened there before it."""
    # An opening bracket is a row of what it stands in and, marked, one of what it holds; a union with itself would read all sources twice.
    mark = F.explode(F.when(F.col("kind") == "open", F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    both = t.withColumn("mark", mark).withColumns({"level": F.when(F.col("mark"), F.col("depth")).otherwise(F.col("depth") - 1), "around": F.when(F.col("mark"), F.col("own_pair"))})
    before = Window.partitionBy("path", "level").orderBy("i", F.desc("mark")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("around", F.last("around", ignorenulls=True).over(before)).filter("not mark").drop("level", "mark")


# ---------------------------------------------------------------- one file


HEADS = frozenset("class interface enum struct trait impl record union namespace".split())
_CALLED = frozenset(CALLS_AFTER.split())
_CLASSES = frozenset("class interface record struct enum trait".split())


class Candidate(NamedTuple):
    """A name that may be called or declared: ``close``, ``args`` and ``after`` of the brackets behind it (None without), ``head`` and ``bracket`` of the pair around it, and, where it is declared, the ``end`` of its body."""

    i: int
    close: int | None
    args: int
    after: str | None
    head: str
    bracket: str
    declared: bool
    end: int | None


class Nesting:
    """The tokens of one file, and what is told by brackets. A pair is named by the place of its opening bracket.

    ``group``: the pair a token is in, below 0 for the depths that are in none; ``close``: where each pair ends, ``LAST`` if it never does; ``opener``: the pair of a closing bracket; ``stop``: the first
    ``{`` or ``;`` behind a token in its own group, -1 without; ``head``: whether a pair is the body of a class, an interface, a macro ..., by the last such word since a ; or a brace.
    """

    def __init__(self, content: str, language: str) -> None:
        self.language = language
        rows = lexed(content, language)
        self.kinds, self.texts, self.lines, self.cols = zip(*rows, strict=True) if rows else ((), (), (), ())
        self.n = len(rows)
        self.group, self.depth = [0] * self.n, [0] * self.n
        self.close: dict[int, int] = {}
        self.opener: dict[int, int] = {}
        self.head: dict[int, str] = {}
        self.commas: dict[int, int] = {}
        self.tail: dict[int, str] = {}
        self.typed: set[int] = set()  # behind :: a line of Fortran declares
        self._open()
        self._stop()

    def _open(self) -> None:
        opened: dict[int, int] = {}
        now, head, edge, typed = 0, -1, -1, False
        rust, fortran, texts = self.language == "rust", self.language == "fortran", self.texts
        for i, (kind, text) in enumerate(zip(self.kinds, texts, strict=True)):
            if kind == "close":
                now -= 1
            self.depth[i] = now
            around = self.group[i] = opened.get(now - 1, now - 1)
            if kind == "close":
                pair = opened.get(now)
                if pair is not None and self.close[pair] == LAST:
                    self.close[pair], self.opener[i] = i, pair
            elif text != "\n" and around >= 0:
                if text == ",":
                    self.commas[around] = self.commas.get(around, 0) + 1
                self.tail[around] = text
            if kind == "open":
                before = texts[i - 1] if i else None
                if rust and before == "!":
                    self.head[i] = "macro"
                else:
                    self.head[i] = texts[head] if text == "{" and head > edge and before not in (")", "const", "noexcept", "override") else ""
                opened[now], self.close[i] = i, LAST
                now += 1
            elif kind == "word" and text in HEADS:
                head = i
            if text in (";", "{", "}"):
                edge = i
            if fortran:
                if typed:
                    self.typed.add(i)
                typed = text == "::" or (typed and text != "\n")

    def _stop(self) -> None:
        self.stop = [-1] * self.n
        last: dict[int, int] = {}
        for i in range(self.n - 1, -1, -1):
            group = self.group[i]
            self.stop[i] = last.get(group, -1)
            if self.texts[i] in ("{", ";") and self.kinds[i] in ("open", "op"):
                last[group] = i

    def text(self, i: int) -> str | None:
        return self.texts[i] if 0 <= i < self.n else None

    def behind(self, pair: int) -> str | None:
        """The token behind a pair."""
        return self.text(self.close[pair] + 1)

    def stop_of(self, pair: int) -> int:
        """The first ``{`` or ``;`` behind a pair on its depth."""
        return self.stop[self.close[pair]] if self.close[pair] != LAST else -1

    def args(self, pair: int) -> int:
        tail = self.tail.get(pair)
        return 0 if tail is None else self.commas.get(pair, 0) + (tail != ",")

    def candidates(self) -> list[Candidate]:
        """Names before brackets, and those behind the words that declare or call."""
        out, fortran = [], self.language == "fortran"
        for i, kind in enumerate(self.kinds):
            if kind != "name":
                continue
            t1, t2 = self.text(i - 1), self.text(i - 2)
            if not (self.text(i + 1) == "(" or (fortran and t1 in ("call", "subroutine", "function")) or t1 in ("fn", "func", "function") or (t1 == "*" and t2 == "function")):
                continue
            pair = i + 1 if self.text(i + 1) == "(" and self.kinds[i + 1] == "open" else None
            close, args, after, stop = (None, 0, None, -1) if pair is None else (self.close[pair], self.args(pair), self.behind(pair), self.stop_of(pair))
            stop = self.stop[i] if stop < 0 else stop  # with type arguments the body is found on the name's own depth
            around = self.group[i]
            head, bracket = (self.head[around], self.texts[around]) if around >= 0 else ("", "")
            has_body = stop >= 0 and self.texts[stop] == "{"
            declared, end = self._declares(i, t1, t2, after, has_body, head), None
            if declared and fortran and t1 in ("function", "subroutine") and self.kinds[i - 1] == "open":
                end = self.close[i - 1]
            elif declared and not fortran and has_body:
                end = self.close[stop]
            out.append(Candidate(i, close, args, after, head, bracket, declared, end))
        return out

    def _declares(self, i: int, t1: str | None, t2: str | None, after: str | None, has_body: bool, head: str) -> bool:
        """Whether the name of a candidate is declared there: t1 and t2 stand before it, ``after`` behind the brackets, ``head`` is the kind of the pair around it."""
        k1, language = self.kinds[i - 1] if i else None, self.language
        if language == "rust":
            return t1 == "fn"
        if language == "go":
            receiver = i - 1 in self.opener and self.text(self.opener[i - 1] - 1) == "func"
            return t1 == "func" or (t1 == ")" and receiver) or head == "interface"
        if language == "fortran":
            return t1 in ("function", "subroutine", "program", "module", "result")
        begins = t1 is None or t1 in ("{", "}", ";") or (t1 == ":" and t2 in ("public", "private", "protected"))
        typed = k1 == "name" or (k1 == "word" and t1 not in _CALLED)
        in_class = head in _CLASSES
        if language == "java":
            return typed or t1 == "]" or (t1 == ">" and (k1 == "close" or in_class)) or after in ("{", "throws") or (head == "enum" and t1 in ("{", ","))
        if language == "typescript":
            member = begins or t1 in ("public", "private", "protected", "static", "async", "get", "set", "readonly", "abstract", "*")
            return t1 == "function" or (t1 == "*" and t2 == "function") or after == "{" or (in_class and member and after in ("{", ":", ";"))
        opens = after in ("{", "throws", "const", "noexcept", "override", "final", "->") or (after == ":" and has_body and head != "body")
        outside = self.depth[i] == 0 or head in ("class", "struct", "namespace")
        return typed or (t1 in ("*", "&", ">", "::", "~") and (opens or (outside and after in (";", "=")))) or (begins and opens)

    def bodies(self, candidates: list[Candidate]) -> list[tuple[int, int, str]]:
        """(start, end, name) of the functions, by their start."""
        return [(x.i, x.end, self.texts[x.i]) for x in candidates if x.end is not None]


def innermost(places: list[int], spans: list[tuple]) -> list:
    """The last value of the innermost of the ``spans`` (start, end, value; by start) around each of the places, which go up; None where there is none. A span holds its start, not its end."""
    out, open_, k = [], [], 0
    for i in places:
        while k < len(spans) and spans[k][0] <= i:
            while open_ and open_[-1][1] <= spans[k][0]:
                open_.pop()
            open_.append(spans[k])
            k += 1
        while open_ and open_[-1][1] <= i:
            open_.pop()
        out.append(open_[-1][2] if open_ else None)
    return out


def functions_of(content: str, language: str) -> list[tuple]:
    """(name, line, end line) of the functions of a source that have a body."""
    f = Nesting(content, language)
    return [(name, f.lines[start], f.lines[start if end == LAST else end]) for start, end, name in f.bodies(f.candidates())]


def calls_of(content: str, language: str) -> list[tuple]:
    """(caller, callee, line, column, arguments) of the calls of a source."""
    f = Nesting(content, language)
    rust, fortran = language == "rust", language == "fortran"
    every, found = f.candidates(), []
    # Nothing inside a macro or a pattern is a call.
    quiet = [(start, f.close[start], True) for start, head in f.head.items() if head == "macro"]
    for x in every:
        t1, after = f.text(x.i - 1), x.after
        pattern = rust and ((after in ("=>", "if") and t1 in ("{", "}", ",", "|", "::", "&", ";")) or (after == "=" and t1 in ("let", "(", ",", "|", "&")) or (after == "|" and t1 in ("{", "}", ",", "|")))
        if pattern and x.close is not None:
            quiet.append((x.i, x.close, True))
        other = (t1 == "new" and language in ("java", "typescript", "cpp")) or (t1 == "@" and language == "java") or x.i in f.typed
        other = other or (language == "cpp" and (t1 == "::" or (t1 in (":", ",") and after in (",", "{") and x.bracket != "(")))
        if (f.text(x.i + 1) == "(" or (fortran and t1 == "call")) and not (x.declared or pattern or other):
            found.append(x)
    heard = [x for x, held in zip(found, innermost([x.i for x in found], sorted(quiet)), strict=True) if not held]
    callers = innermost([x.i for x in heard], f.bodies(every))
    return [(caller or MODULE, f.texts[x.i], f.lines[x.i], f.cols[x.i], x.args) for x, caller in zip(heard, callers, strict=True)]


def functions(sources: DataFrame, spread: bool = True) -> DataFrame:
    """(path, name, line, end_line) of the functions that have a body."""
    return read(sources, "name string, line int, end_line int", functions_of, spread)


def calls(sources: DataFrame, spread: bool = True) -> DataFrame:
    """(path, caller, callee, line, column, arg_count)."""
    return read(sources, "caller string, callee string, line int, column int, arg_count int", calls_of, spread)


def references(sources: DataFrame) -> DataFrame:
    """(path, symbol, line): names in the place of a type, the first of each in a file. Approximate, as only the tokens beside a name are looked at.

    A type stands behind a colon or arrow, a word like ``class``, ``impl``, ``extends`` or ``new``, or inside type arguments, and, in languages that write it first or last, beside the name that it types.
    """
    c = F.col
    t = inside_of(nested(tokens(sources)))
    opened = t.filter("kind = 'open'").select(c("path").alias("p"), c("own_depth").alias("d"), c("own_pair").alias("o"), c("text").alias("within"))
    t = t.filter("kind = 'name'").join(shuffled(opened), (c("path") == c("p")) & (c("depth") - 1 == c("d")) & (c("around") == c("o")), "left")
    upper = c("text").rlike("^[A-Z]")
    argument = ((c("within") == "<") & c("t1").isin("<", ",", "&", "extends", ".", "?")) | (upper & (((c("t1") == "<") & c("next").isin(">", ",", "<")) | ((c("t1") == ",") & (c("next") == ">"))))
    free = ~F.coalesce(c("next").isin("(", "!", "::", "."), F.lit(False))
    rust = (c("t1").isin("struct", "enum", "trait", "impl", "for", "dyn", "union", "type", "as") | (c("t1").isin(":", "->", "&", ">", "mut") & upper) | ((c("t1") == "::") & upper & c("next").isin("<", ",", ")", ">", "{", ";")) | argument | (c("t1").isin("[", "(") & upper & c("next").isin("]", ">", "<", ";"))) & free
    rust = rust & ~c("text").isin("i8", "i16", "i32", "i64", "i128", "isize", "u8", "u16", "u32", "u64", "u128", "usize", "f32", "f64", "bool", "char", "str")
    go = (c("t1") == "type") | ((c("k1") == "name") & ~F.coalesce(c("next").isin("(", "."), F.lit(False))) | (c("t1").isin("]", "*", ")", "chan") & c("next").isin("{", ",", ")", "=", "\n") & (c("k1") != "name") & (upper | c("t1").isin("]")))
    java = c("t1").isin("class", "interface", "enum", "extends", "implements", "new", "throws", "instanceof") | ((c("next_kind") == "name") & ~F.coalesce(c("t1").isin("."), F.lit(False))) | argument | ((c("next") == "<") & upper) | (c("t1").isin(",") & upper & c("next").isin("{", ","))
    typescript = (c("t1").isin("class", "interface", "enum", "extends", "implements", "type", "as") | (c("t1").isin(":", "|", "&") & upper) | argument) & free
    cpp = (c("t1").isin("class", "struct", "enum", "union", "new") | ((c("next_kind") == "name") & (c("k1") != "name")) | (c("next").isin("*", "&", "<") & upper) | argument) & ~F.coalesce(c("next").isin("::"), F.lit(False))
    place = F.when(c("language") == "rust", rust).when(c("language") == "go", go).when(c("language") == "java", java).when(c("language") == "typescript", typescript).when(c("language").isin("c", "cpp"), cpp)
    return t.filter(F.coalesce(place, F.lit(False)) & (c("text") != "_")).groupBy("path", c("text").alias("symbol")).agg(F.min("line").alias("line"))
