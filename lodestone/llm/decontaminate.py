"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as their words (runs of letters and digits) in lower case, with a space before, after and between
them, so that an item of few letters, which may not differ, is found as whole words only. An item of n
characters may differ by k = floor(rate * n) edits, its outer spaces not counted in n. It is cut into k + 1 pieces, one of which a match must hold unchanged: an
Aho-Corasick automaton finds the pieces, and Myers' bit-parallel distance verifies a hit, first over two
neighbouring pieces with one error, then over ever longer parts up to the whole item, so that a chance hit ends early.

Items are sent to the executors in blocks of bounded size, and each block scans all texts. An item without a letter or digit
matches nothing; a null text holds nothing; items that repeat a text are each reported. For each document and item the
first verified place counts: ``distance`` is its distance, ``at`` the number of words up to its end.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

RATE = 0.1
BLOCK_CHARS = 4_000_000
WORDS = re.compile(r"[^\W_]+")
HITS = "hits array<struct<item_id:bigint,distance:int,at:bigint>>"


def plain(text: str | None) -> str:
    words = WORDS.findall((text or "").lower())
    return f" {' '.join(words)} " if words else ""


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(eq: dict[str, int], m: int, text: str, most: int) -> tuple[int, int]:
    """(smallest distance of a pattern of m letters to a part of ``text``, where the first such part ends); (most + 1, -1) if above ``most``."""
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score = full, 0, m
    best, at = most + 1, -1
    for j, c in enumerate(text, 1):
        e = eq.get(c, 0)
        x = e | down
        d = ((((e & up) + up) ^ up) | x | down) & full
        grow, shrink = down | ~(d | up) & full, up & d
        if grow & top:
            score += 1
        elif shrink & top:
            score -= 1
        if score < best:
            best, at = score, j
            if not best:
                break
        grow, shrink = grow << 1 & full, shrink << 1 & full
        up = (shrink | ~(d | grow)) & full
        down = grow & d
    return best, at


class Item:
    """A test item, its pieces and the parts to verify one after another around each piece."""

    def __init__(self, key: int, text: str, rate: float) -> None:
        self.key, self.text = key, text
        bare = len(text.strip())
        self.k = max(0, min(int(bare * rate), bare - 1))
        n = self.k + 1
        self.cuts = [len(text) * i // n for i in range(n + 1)]
        self.eq: dict[tuple[int, int], dict[str, int]] = {}

    def above(self, leaf: int) -> list[tuple[int, int]]:
        """Parts (first piece, last piece) that hold the leaf, the smallest first."""
        a, b, out = 0, self.k + 1, []
        while b - a > 1:
            out.append((a, b))
            mid = (a + b) // 2
            a, b = (a, mid) if leaf < mid else (mid, b)
        return out[::-1]

    def verify(self, text: str, leaf: int, start: int) -> tuple[int, int] | None:
        """(distance, end) if the item is at the place where its piece starts in ``text``."""
        found = (0, start + len(self.text))
        for a, b in self.above(leaf):
            most, s, e = b - a - 1, self.cuts[a], self.cuts[b]
            lo = max(0, start - (self.cuts[leaf] - s) - most)
            hi = start + (e - self.cuts[leaf]) + most
            eq = self.eq.get((a, b))
            if eq is None:
                eq = self.eq[a, b] = masks(self.text[s:e])
            d, end = myers(eq, e - s, text[lo:hi], most)
            if d > most:
                return None
            found = (d, lo + end)
        return found


class Finder:
    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        import ahocorasick

        self.items = [Item(k, t, rate) for k, t in items if t]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(self.items):
            for leaf in range(item.k + 1):
                places.setdefault(item.text[item.cuts[leaf] : item.cuts[leaf + 1]], []).append((i, leaf))
        self.auto = ahocorasick.Automaton()
        for piece, where in places.items():
            self.auto.add_word(piece, (len(piece), where))
        if places:
            self.auto.make_automaton()

    def find(self, text: str) -> list[dict]:
        found: dict[int, dict] = {}
        for last, (size, where) in self.auto.iter(text) if self.items else ():
            for i, leaf in where:
                if i not in found and (hit := self.items[i].verify(text, leaf, last + 1 - size)):
                    found[i] = {"item_id": self.items[i].key, "distance": hit[0], "at": len(text[: hit[1]].split())}
        return sorted(found.values(), key=lambda x: (x["item_id"] is None, x["item_id"], x["at"]))


def scan(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text: str | tuple[str, str] = "text", keep: list[str] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` (all columns, or those of ``keep``) with ``hits``, the items found in each text. A column of that name is replaced; documents that repeat a row are each scanned."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // block_chars)) if total > block_chars else 1
    keep = [c for c in (docs.columns if keep is None else keep) if c != "hits"]
    earlier = next(f"earlier{k}" for k in range(len(docs.columns) + 1) if f"earlier{k}" not in docs.columns)
    out = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text[0] if isinstance(text, tuple) else text])])
    for b in range(blocks):
        own = [(r["item_id"], plain(r["text"])) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]

        def start(own=own):
            finder = Finder(own, rate)
            return lambda texts: [pa.array([finder.find(plain(t)) for t in texts], pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("at", pa.int64())])))]

        if not b:
            out = common.add_columns(out, text, HITS, start, out.columns if blocks > 1 else keep)
        else:
            out = common.checkpointed(out.withColumnRenamed("hits", earlier))
            out = common.add_columns(out, text, HITS, start).withColumn("hits", F.concat(earlier, "hits")).drop(earlier)
    return out.select(*[F.col(f"`{c}`") for c in keep], "hits")


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, at) for each benchmark item in each document."""
    return scan(docs, benchmark, rate, keep=["doc_id"]).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents in which no item is found, all columns."""
    return scan(common.whole(docs), benchmark, rate, ("row", "text"), keep=["row"]).filter(F.size("hits") == 0).select("row.*")
