"""HTML extraction by union-free regular-expression inference.

Pages become token streams: tags with their class and id words (numbers in them don't count), and texts. From all pages of a host
a wrapper is inferred: each page's stream is folded, so that a part that follows itself becomes a
repeated group; then the wrapper of the first page is aligned with the others one by one. Texts that differ become slots,
parts on one side only become optional groups, groups are aligned inside. A wrapper so has constants, slots, ``( )?`` and
``( )+``, and no unions.

The wrapper's parts are labelled once (``Wrapper``), from the names of elements, the words and the mass of the text in
its slots: a part is main text or not. A page is then matched with its host's wrapper, and its text is what matches slots
and constants labelled as main text:

* Elements of ``OUT_TAGS`` or ``OUT_WORDS`` are out. A word of several parts counts by its last, or by its first if the rest are words of layout
  (``post-comments``, ``comments-area``, but not ``comments-open`` or ``category-social``). An article or main element is out only as a reader's comment, advert
  or the like, and an element around at least half of all marked text is never out by its words or as a form.
* Main parts are those marked as article, main or by a content word; an article counts only if it has a quarter of the mass of the
  other text that isn't out. Where nothing is marked, the whole page is a main part, but lists whose text is all in links.
* Inside marked parts nothing is the template's: a heading that all articles share stays, however many pages there are. Where nothing is marked, a block that is
  the same constant on all pages is the template's if the slots hold as much text as the constants. So pages that are copies but for a date stay.

A page without any of the wrapper's main parts is labelled by the wrapper inferred from itself; a part of a page that the wrapper doesn't hold
goes by the part around it. Elements nested deeper than ``DEEPEST`` are read in line with the one at that depth; a wrapper
takes up no more than ``WIDEST`` parts of one element from other pages. Neither drops text.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed. Null html and
pages without main text give an empty text. A null url counts as a host of its own name, ''. One row for each row.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left, bisect_right
from collections import Counter, OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

#: Buckets of a host's pages that are aligned apart, before their wrappers are.
BUCKETS = 256
#: Wrappers of at most so many bytes in all are sent to every executor; above, pages are joined with their host's wrapper.
SEND_BYTES = 32 << 20
DEEPEST, WIDEST = 64, 2_000
#: Two lists of parts are aligned in full if the product of their lengths is at most this.
CELLS = 10_000

RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without main text, and words of a class, id or role that say so.
OUT_TAGS = frozenset("nav aside footer form script style noscript template head title button select textarea input iframe svg canvas dialog menu audio video".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts nav navbar navigation navigator menu menus topbar toolbar breadcrumb breadcrumbs sidebar sidebars side aside rail widget widgets footer foot colophon masthead comment comments commentlist disqus replies respond reactions discussion share shares sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay pagination pager skip complementary contentinfo search searchbox paywall tags".split()
)
HEADERS = frozenset("header masthead site-header page-header topbar".split())
MAIN_WORDS = frozenset("article articlebody article-body article-content content contents main maincontent main-content post post-body post-content entry entry-content story story-body body-text".split())
#: Words of layout behind one of ``OUT_WORDS``; first parts that only describe; words that say nothing inside main text.
LAYOUT = frozenset("area areas bar bars block blocks bottom box button buttons column container content form frame group header heading icon icons inner item items left link links list lists main menu outer panel post posts right row section slot title top unit wrap wrapper zone articles stories".split())
QUALIFIERS = frozenset("author cat category format has hide is no not series show status tag taxonomy term topic type with without".split())
SOFT = frozenset("alert alerts discussion discussions rail search side".split())
#: What an article element must be called to be none, and those of readers, which no mass of text makes main.
NO_ARTICLE = frozenset("comment comments comment-body commentlist reply replies ad ads advert advertisement sponsored promo widget".split())
READERS = frozenset("comment comments commentlist disqus replies reply respond reactions".split())
CLOSES_P = BLOCKS - {"body", "html", "head"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody"}, "tbody": {"thead", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}, "thead": {"table"}}

LEX = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

NUMBER = re.compile(r"\d+")

# A token is a tuple: ("o", tag, words) opens, ("c", tag) closes, ("t", text) is text, ("b",) breaks a line.


def tokens(page: str) -> list[tuple]:
    """The page's tokens, with end tags where HTML leaves them out."""
    out: list[tuple] = []
    stack: list[str] = []
    open_: Counter[str] = Counter()
    at, n = 0, len(page)

    def text(s: str) -> None:
        if s:
            out.append(("t", " " if s.isspace() else s))

    def close(upto: int) -> None:
        while len(stack) > upto:
            open_[stack[-1]] -= 1
            out.append(("c", stack.pop()))

    while at < n:
        m = LEX.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[1]
        if not tag:
            continue
        tag = tag.lower()
        if page[m.start() + 1] == "/":
            if tag == "p" and not open_["p"]:
                continue
            if open_[tag]:
                close(len(stack) - 1 - stack[::-1].index(tag))
            continue
        if tag == "br":
            out.append(("b",))
            continue
        if tag in CLOSES_P and open_["p"]:
            k = len(stack) - 1 - stack[::-1].index("p")
            if not any(s in ("button", "td", "th", "table", "object", "caption") for s in stack[k:]):
                close(k)
        if tag in CLOSED_BY:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] in CLOSED_BY[tag]:
                    close(k)
                    break
                if stack[k] in SCOPE[tag]:
                    break
        words: tuple[str, ...] = ()
        if m[2].strip():
            found = []
            for a in ATTR.finditer(m[2]):
                name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if name in ("class", "id", "role", "itemprop"):
                    found += value.lower().split()
                elif name == "hidden" or name == "style" and HIDDEN.search(value):
                    found.append("hidden!")
            words = tuple(sorted({NUMBER.sub("#", w) for w in found}))
        out.append(("o", tag, words))
        if tag in VOID or m[0].endswith("/>") and tag not in BLOCKS:
            out.append(("c", tag))
            continue
        stack.append(tag)
        open_[tag] += 1
        if tag in RAW:
            e = RAW_END[tag].search(page, at)
            at = e.end() if e else n
            close(len(stack) - 1)
    close(0)
    return out


# ---------------------------------------------------------------- wrappers
# Parts of a wrapper: ["e", tag, words, parts] element, ["t", digest, letters] text (a slot if the digest is null, with the
# letters of all pages), ["b"] line break, ["n"] end of a block in line, ["?", parts] optional, ["+", parts] repeated.
# White space between tags is no part.


def elements(ts: list[tuple]) -> list:
    """The stream as a forest: texts and breaks, and (opening token, children)."""
    root: list = []
    stack, deeper, skip = [root], [], 0
    for t in ts:
        if t[0] == "o":
            if len(stack) <= DEEPEST and not deeper:
                node = (t, [])
                stack[-1].append(node)
                stack.append(node[1])
                continue
            out = skip or role(t[1], t[2], True) == "out"
            deeper.append((t[1], bool(out)))
            skip += bool(out)
            if not skip and t[1] in BLOCKS:
                stack[-1].append(("n",))
        elif t[0] == "c":
            if deeper:
                tag, out = deeper.pop()
                skip -= out
                if not skip and tag in BLOCKS:
                    stack[-1].append(("n",))
            elif len(stack) > 1:
                stack.pop()
        elif not skip:
            stack[-1].append(t)
    return root


def is_element(x: tuple) -> bool:
    return len(x) == 2 and isinstance(x[1], list)


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def first_wrapper(forest: list) -> list:
    """A page as a wrapper of constants, elements and repeated groups."""
    out = []
    for x in forest:
        if is_element(x):
            out.append(["e", x[0][1], " ".join(x[0][2]), first_wrapper(x[1])])
        elif x[0] != "t":
            out.append([x[0]])
        elif x[1] != " ":
            out.append(["t", digest(x[1]), len(x[1])])
    return fold(out)


def key(p: list) -> tuple:
    """Parts with the same key can be one part of a wrapper."""
    while p[0] in "?+" and len(p[1]) == 1:
        p = p[1][0]
    return (p[1], p[2]) if p[0] == "e" else (p[0], *map(key, p[1])) if p[0] in "?+" else (p[0],)


def fold(parts: list, longest: int = 4) -> list:
    """Parts that follow themselves become a repeated group, the shortest first."""
    for size in range(1, longest + 1):
        keys, out, i = [key(p) if p[0] == "e" else None for p in parts], [], 0
        if len(parts) < 2 * size:
            break
        while i < len(parts):
            unit, j, merged = keys[i : i + size], i + size, None
            if None not in unit:
                while keys[j : j + size] == unit:
                    merged = align(merged or parts[i : i + size], parts[j : j + size])
                    j += size
            if merged is None:
                out.append(parts[i])
                i += 1
            else:
                out.append(["+", merged])
                i = j
        parts = out
    return parts


def common_parts(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a common subsequence of two lists of keys: a longest one where they are short, else around keys that are unique."""
    start, n, m = 0, len(a), len(b)
    while start < n and start < m and a[start] == b[start]:
        start += 1
    while n > start and m > start and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    ends = [(i, i) for i in range(start)], [(n + k, m + k) for k in range(len(a) - n)]
    return ends[0] + _between(a, b, start, n, start, m) + ends[1]


def _between(a: list, b: list, s: int, n: int, z: int, m: int) -> list[tuple[int, int]]:
    if (n - s) * (m - z) <= CELLS:
        best = [[0] * (m - z + 1) for _ in range(n - s + 1)]
        for i in range(n - 1, s - 1, -1):
            row, below = best[i - s], best[i - s + 1]
            for j in range(m - 1, z - 1, -1):
                row[j - z] = below[j - z + 1] + 1 if a[i] == b[j] else max(below[j - z], row[j - z + 1])
        out, i, j = [], s, z
        while i < n and j < m:
            if a[i] == b[j]:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif best[i - s + 1][j - z] >= best[i - s][j - z + 1]:
                i += 1
            else:
                j += 1
        return out
    own, other = Counter(a[s:n]), Counter(b[z:m])
    where = {k: j for j, k in enumerate(b[z:m], z) if other[k] == 1}
    single = [(i, where[a[i]]) for i in range(s, n) if own[a[i]] == 1 and a[i] in where]
    tails, ends, before = [], [], []  # longest increasing subsequence of their places
    for k, (_, j) in enumerate(single):
        at = bisect_left(tails, j)
        before.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [j], [k]
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(single[k])
        k = before[k]
    if not chain:
        out, j = [], z  # next place of the same key nearby
        for i in range(s, n):
            near = next((q for q in range(j, min(m, j + 16)) if b[q] == a[i]), None)
            if near is not None:
                out.append((i, near))
                j = near + 1
        return out
    out, i, j = [], s, z
    for x, y in [*chain[::-1], (n, m)]:
        if i < x and j < y:
            out += _between(a, b, i, x, j, y)
        if x < n:
            out.append((x, y))
        i, j = x + 1, y + 1
    return out


def align(a: list, b: list) -> list:
    """The wrapper that both match: parts in common are merged, the rest is optional."""
    out, i, j = [], 0, 0
    for x, y in [*common_parts([key(p) for p in a], [key(p) for p in b]), (len(a), len(b))]:
        out += [optional(p) for p in a[i:x]]
        out += [optional(p) for p in b[j:y]] if len(out) < WIDEST else []
        if x < len(a):
            out.append(merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def optional(x: list) -> list:
    return x if x[0] == "?" else ["?", [x]]


def merge(a: list, b: list) -> list:
    """One part for two of the same key."""
    for mark in "?+":
        if a[0] == mark or b[0] == mark:
            inner = align(a[1] if a[0] == mark else [a], b[1] if b[0] == mark else [b])
            return [mark, [x[1][0] if x[0] == mark and len(x[1]) == 1 else x for x in inner]]
    if a[0] == "e":
        return ["e", a[1], a[2], align(a[3], b[3])]
    if a[0] == "t":
        return ["t", a[1] if a[1] == b[1] else None, a[2] + b[2]]
    return a


def infer(pages: list[str]) -> list:
    wrapper = None
    for page in pages:
        own = first_wrapper(elements(tokens(page)))
        wrapper = own if wrapper is None else align(wrapper, own)
    return wrapper or []


# ---------------------------------------------------------------- labels


def says_out(w: str, inside: bool) -> bool:
    """Whether a class, id or role word names what isn't main text."""
    if w in OUT_WORDS:
        return not (inside and w in SOFT)
    if not inside and w in HEADERS:
        return True
    bits = [b for b in re.split(r"[-_#]+", w) if b]
    if w in MAIN_WORDS or not bits or bits[0] in QUALIFIERS:
        return False
    return bits[-1] in OUT_WORDS and not (inside and bits[-1] in SOFT) or bits[0] in OUT_WORDS and LAYOUT.issuperset(bits[1:])


def role(tag: str, words: tuple[str, ...], inside: bool) -> str:
    """"out" (no main text), "article", "main" or "named" (a main part starts) or "" (as the element around it)."""
    if tag in OUT_TAGS or "hidden!" in words:
        return "out"
    if tag == "header" and not inside:
        return "out"
    if tag in ("article", "main"):
        return tag if NO_ARTICLE.isdisjoint(words) else "out"
    if tag not in ("html", "body") and any(says_out(w, inside) for w in words):
        return "out"
    return "" if MAIN_WORDS.isdisjoint(words) else "named"


def words_of(p: list) -> tuple[str, ...]:
    return tuple(p[2].split(" ")) if p[2] else ()


def said(p: list, inside: bool, kept: frozenset[int] = frozenset()) -> str:
    r = role(p[1], words_of(p), inside)
    if r == "out" and id(p) in kept:
        return p[1] if p[1] in ("article", "main") else "" if MAIN_WORDS.isdisjoint(words_of(p)) else "named"
    return r


def around_main(parts: list) -> frozenset[int]:
    """Elements that hold at least half of all text in marked elements, though their words, or that they are forms, say that they are out."""
    held: list[tuple[list, int]] = []

    def marked(parts: list) -> tuple[int, int]:
        """Letters in all, and in the outermost marked elements."""
        letters = total = 0
        for p in parts:
            if p[0] == "t":
                letters += p[2]
            elif p[0] in "?+":
                inner = marked(p[1])
                letters, total = letters + inner[0], total + inner[1]
            elif p[0] == "e":
                words = words_of(p)
                if p[1] in OUT_TAGS and p[1] != "form" or not READERS.isdisjoint(words) or "hidden!" in words:
                    continue
                inner, below = marked(p[3])
                own = inner if p[1] in ("article", "main") or not MAIN_WORDS.isdisjoint(words) else below
                held.append((p, own))
                letters, total = letters + inner, total + own
        return letters, total

    total = marked(parts)[1]
    return frozenset(id(p) for p, own in held if total and 2 * own >= total)


def masses(parts: list, inside: bool, found: Counter, linked: bool = False, kept: frozenset[int] = frozenset()) -> None:
    """Letters in parts that aren't out: all, in links, and below each mark."""
    for p in parts:
        if p[0] == "t":
            found["all"] += p[2]
            found["links"] += p[2] if linked else 0
        elif p[0] == "e":
            r = said(p, inside, kept)
            if r == "out":
                continue
            before = found["all"]
            masses(p[3], inside or bool(r), found, linked or p[1] == "a", kept)
            if r:
                found[r] += found["all"] - before
        elif p[0] in "?+":
            masses(p[1], inside, found, linked, kept)


def main_rank(parts: list, kept: frozenset[int] = frozenset()) -> str:
    """What marks main parts: article, main or a content word; "" if nothing with text does."""
    found: Counter = Counter()
    masses(parts, False, found, kept=kept)
    widest = max(found["main"], found["named"])
    if found["article"] and 4 * found["article"] >= widest:
        return "article"
    return "main" if found["main"] and 4 * found["main"] >= found["named"] else "named" if found["named"] else ""


class Level:
    """Labelled parts of one element of a wrapper, in a row; those of a repeated group are followed by its first."""

    def __init__(self, parts: list, wrapper: Wrapper, main: bool) -> None:
        self.items: list[tuple] = []  # (key, required, label, level)
        self.back: list[int] = []
        self.end: list[int] = []
        self._add(parts, wrapper, main, True, None)
        self.at: dict[tuple, list[int]] = {}
        for i, x in enumerate(self.items):
            self.at.setdefault(x[0], []).append(i)
        self.required = {k: [i for i in v if self.items[i][1]] for k, v in self.at.items()}
        self.plain = all(len(v) == 1 for v in self.at.values())

    def _add(self, parts: list, wrapper: Wrapper, main: bool, required: bool, group: int | None) -> None:
        for p in parts:
            if p[0] in "?+":
                first = len(self.items)
                top = first if group is None and p[0] == "+" else group
                self._add(p[1], wrapper, main, required and p[0] == "+", top)
                if p[0] == "+" and group is None:
                    for i in range(first, len(self.items)):
                        self.back[i], self.end[i] = first, len(self.items)
                continue
            n = len(self.items)
            self.back.append(n)
            self.end.append(n)
            self.items.append((key(p), required, *wrapper.label(p, main)))

    def match(self, nodes: list) -> list[tuple | None]:
        """The wrapper's part (label, level) for each node, or none: the nearest one that follows, or one of the same repeated group."""
        keys = [(x[0][1], " ".join(x[0][2])) if is_element(x) else None if x[0] == "t" and x[1] == " " else (x[0],) for x in nodes]
        left = Counter(keys) if not self.plain else None
        out, pos = [], -1
        for k in keys:
            places = self.at.get(k)
            if not places:
                out.append(None)
                continue
            hit = None
            if pos >= 0 and self.end[pos] > pos:
                within = bisect_right(places, pos)
                if within < len(places) and places[within] < self.end[pos]:
                    hit = places[within]
                else:
                    again = bisect_left(places, self.back[pos])
                    hit = places[again] if again < len(places) and places[again] <= pos else None
            if hit is None:
                after = bisect_right(places, pos)
                if after < len(places):
                    hit = places[after]
                    if left is not None and not self.items[hit][1]:
                        must = self.required[k]
                        q = bisect_right(must, pos)
                        if q < len(must) and left[k] <= len(must) - q:
                            hit = must[q]
            if left is not None:
                left[k] -= 1
            if hit is None:
                out.append(None)
            else:
                pos = hit
                out.append(self.items[hit][2:])
        return out


class Wrapper:
    """A host's wrapper with labels: "out", "main" (text of the page) or "" (main parts may be inside)."""

    def __init__(self, parts: list) -> None:
        self.kept = around_main(parts)
        self.rank = main_rank(parts, self.kept)
        self.drop: set[int] = set()
        if not self.rank:
            self._template(parts)
        self.level = Level(parts, self, not self.rank)

    def _template(self, parts: list) -> None:
        """Blocks of required constants where nothing is marked, if slots hold most of the text."""
        slots, held, blocks = 0, 0, []

        def walk(parts: list, sure: bool, block: list) -> None:
            nonlocal slots, held
            for p in parts:
                if p[0] == "e":
                    if said(p, True, self.kept) == "out":
                        continue
                    if p[1] in BLOCKS:
                        blocks.append([])
                        walk(p[3], sure, blocks[-1])
                        blocks.append(block := [])
                    else:
                        walk(p[3], sure, block)
                elif p[0] in "?+":
                    walk(p[1], sure and p[0] == "+", block)
                elif p[0] == "t":
                    block.append((p, sure and p[1] is not None))
                    if p[1] is None:
                        slots += p[2]
                    else:
                        held += p[2] if sure else 0
                elif p[0] == "n":
                    blocks.append(block := [])

        blocks.append([])
        walk(parts, True, blocks[-1])
        if slots >= max(held, 1):
            self.drop = {id(p) for b in blocks if all(same for _, same in b) for p, _ in b}

    def label(self, p: list, main: bool) -> tuple:
        if p[0] == "t":
            return ("main" if main and id(p) not in self.drop else "out", None)
        if p[0] != "e":
            return ("main" if main else "", None)
        r = said(p, main, self.kept)
        if r == "out" or not self.rank and self._menu(p):
            return ("out", None)
        inner = main or r == self.rank
        return ("main" if inner else "", Level(p[3], self, inner))

    @staticmethod
    def _menu(p: list) -> bool:
        """A list of links, and nothing else."""
        if p[1] not in ("ul", "ol", "dl"):
            return False
        found: Counter = Counter()
        masses(p[3], True, found)
        return found["all"] > 0 and found["all"] == found["links"]

    def read(self, page: str | None) -> str:
        forest = elements(tokens(page or ""))
        text = self._text(forest)
        return Wrapper(first_wrapper(forest))._text(forest, True) if text is None else text

    def _text(self, forest: list, own: bool = False) -> str | None:
        """The text that matches parts labelled as main text; none if the page has no main part of the wrapper."""
        blocks: list[str] = []
        line: list[str] = []
        found = not self.rank or own

        def end() -> None:
            s = " ".join(html.unescape("".join(line)).split())
            if s:
                blocks.append(s)
            line.clear()

        def walk(nodes: list, level: Level | None, main: bool) -> None:
            nonlocal found
            for x, hit in zip(nodes, level.match(nodes) if level else [None] * len(nodes), strict=True):
                if is_element(x):
                    _, tag, words = x[0]
                    if hit:
                        label, inner = hit
                    else:
                        r, inner = role(tag, words, main), None
                        full = level is not None and len(level.items) >= WIDEST and r and r == self.rank
                        label = "out" if r == "out" else "main" if main or full else ""
                    block = tag in BLOCKS
                    if block:
                        end()
                    if label != "out":
                        found = found or label == "main"
                        walk(x[1], inner, label == "main")
                        if block:
                            end()
                elif x[0] == "n":
                    end()
                elif hit[0] == "main" if hit else main:
                    line.append(x[1] if x[0] == "t" else " ")

        walk(forest, self.level, not self.rank)
        end()
        return "\n".join(blocks) if found else None


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"), host_of(url).alias("host"))

    def fold_all(batches):
        for batch in batches:
            own = [json.dumps(first_wrapper(elements(tokens(p)))) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(own, pa.string()), pa.array([1] * len(own), pa.int64())], ["host", "wrapper", "pages"])

    def align_all(batches):
        """Rows come sorted by host and bucket: one wrapper for each. Equal pages count once."""
        at, last, wrapper, n = None, None, None, 0
        done: list[tuple] = []
        for batch in batches:
            for host, b, own, k in zip(*(batch.column(c).to_pylist() for c in ("host", "b", "wrapper", "pages")), strict=True):
                if (host, b) != at:
                    if at is not None:
                        done.append((*at, json.dumps(wrapper), n))
                    at, wrapper, n = (host, b), json.loads(own), k
                elif own != last:
                    wrapper, n = align(wrapper, json.loads(own)), n + k
                last = own
            yield table_of(done)
            done = []
        yield table_of([] if at is None else [(*at, json.dumps(wrapper), n)])

    def table_of(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))], ["host", "b", "wrapper", "pages"])

    def aligned(frame: DataFrame) -> DataFrame:
        return frame.repartition("host", "b").sortWithinPartitions("host", "b", "wrapper").mapInArrow(align_all, "host string, b int, wrapper string, pages long")

    # Every page of a host counts: aligned in buckets by hash, then the buckets' wrappers with each other.
    folded = rows.filter("html is not null").select("host", "html").mapInArrow(fold_all, "host string, wrapper string, pages long")
    parts = aligned(folded.withColumn("b", F.pmod(F.xxhash64("wrapper"), F.lit(BUCKETS)).cast("int")))
    learned = common.checkpointed(aligned(parts.withColumn("b", F.lit(0))).select(F.col("host").alias("h"), "wrapper", "pages"))
    total = learned.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(learned) if total <= SEND_BYTES else learned, F.col("host") == F.col("h"), "left").select("page_id", "url", "html", "wrapper", "pages")

    def run(batches):
        known: OrderedDict[str, Wrapper] = OrderedDict()
        for batch in batches:
            out = []
            for page, wrapper, n in zip(*(batch.column(c).to_pylist() for c in ("html", "wrapper", "pages")), strict=True):
                w = known.get(wrapper or "[]")
                if w is None:
                    w = known[wrapper or "[]"] = Wrapper(json.loads(wrapper or "[]"))
                    if len(known) > 500:
                        known.popitem(last=False)
                out.append(w.read(page))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
