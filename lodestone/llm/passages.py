"""Passages of many words that an earlier place holds as well, wherever they begin and end in a line or sentence. The earliest copy stays.

Words, places and their order are those of ``units``: runs of anything but ASCII white space, compared in lower case. A run of ``words`` words is repeated if
an earlier text holds it, or the same text at least ``words`` words before, so that a copy never takes words from the one that is kept.

Not every run is shuffled. The least hash of the shingles in a run (two fifths of its words each) is its anchor, which neighbouring runs mostly share; equal runs have
equal anchors. So anchors are counted first, and only runs whose anchor occurs twice are compared, by digests of 128 bits: no repeated run is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import common, units
from lodestone.session import shuffled

WORDS = 50
FACTORS = (6364136223846793005, 3202034522624059733)
ANCHOR = "doc_id long, tie long, anchor long, n long"


class Known(dict):
    """Numbers of words, and the two hashes of each."""

    def __init__(self):
        self.halves: tuple[list[int], list[int]] = ([], [])

    def __missing__(self, word: str) -> int:
        d = hashlib.blake2b(word.encode(), digest_size=16).digest()
        for half, part in zip(self.halves, (d[:8], d[8:]), strict=True):
            half.append(int.from_bytes(part, "little"))
        self[word] = len(self)
        return len(self) - 1


def hashes_of(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the two hashes of each of its words."""
    known = Known()
    at = []
    for t in texts:
        words = (units.WORDS.findall if units.OTHER_SPACE.search(t) else str.split)(t.lower())
        at.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
    a, b = (np.array(x, np.uint64) for x in known.halves)
    return [(a[k], b[k]) for k in at]


def rolling(x: np.ndarray, k: int, factor: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``k`` values, put together from runs of powers of two."""
    out, size, part, n = None, 0, x, 1
    while k:
        if k & 1:
            out = part if out is None else out[: max(0, len(part) - size)] * np.uint64(factor) + part[size:]
            size += n
        if k := k >> 1:
            part = part[:-n] * np.uint64(factor) + part[n:]
            factor, n = factor * factor % 2**64, 2 * n
    return out


def least(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each run of ``k`` values."""
    n = 1
    while 2 * n <= k:
        x, n = np.minimum(x[:-n], x[n:]), 2 * n
    return np.minimum(x[: len(x) - (k - n)], x[k - n :])


def anchors_of(x: np.ndarray, words: int) -> np.ndarray:
    """The anchor of each run of ``words`` words, from one hash a word."""
    shingle = max(1, 2 * words // 5)
    return least(rolling(x, shingle, FACTORS[0]), words - shingle + 1).view(np.int64)


def _rows(given: DataFrame, schema: str, cut: Callable[..., list], *more: str) -> DataFrame:
    """(doc_id, tie) of each text with the columns that ``cut`` makes of (text, its words' hashes, columns ``more``)."""
    kinds = [pa.int32() if x.split()[1] == "int" else pa.int64() for x in schema.split(",")]
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                docs, ties, texts, *rest = (part.column(c).to_pylist() for c in ("doc_id", "tie", "text", *more))
                texts = [t or "" for t in texts]
                cols: list[list] = [[] for _ in names]
                for doc, tie, found in zip(docs, ties, map(cut, texts, hashes_of(texts), *rest), strict=True):
                    n = len(found[0]) if found else 0
                    if n:
                        cols[0].append(pa.array([doc] * n, pa.int64()))
                        cols[1].append(pa.array(np.full(n, tie)))
                        for c, v in zip(cols[2:], found, strict=True):
                            c.append(pa.array(v))
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c).cast(t) for c, t in zip(cols, kinds, strict=True)], names)

    return given.mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, first_word, n_words, start, end, tie) of the runs of words that go: repeated runs of ``words`` words, those that touch or overlap as one.

    ``tie`` is the hash of the text, as in ``units.repeated_units``; ``units.without`` takes the result.
    """

    def anchors(text, hashes):
        if len(hashes[0]) < words:
            return None
        found = anchors_of(hashes[0], words)
        values, first, back = np.unique(found, return_index=True, return_inverse=True)
        last = np.zeros(len(values), np.int64)
        last[back] = np.arange(len(found))  # the last one written stays
        return values, np.where(last - first >= words, 2, 1)

    def runs(text, hashes, wanted):
        at = np.flatnonzero(np.isin(anchors_of(hashes[0], words), np.array(wanted, np.int64)))
        if not len(at):
            return None
        spans = np.array([m.span() for m in units.WORDS.finditer(text)])
        a, b = (rolling(x, words, f)[at].view(np.int64) for x, f in zip(hashes, FACTORS, strict=True))
        return at, spans[at, 0], spans[at + words - 1, 1], a, b

    given = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("tie"), F.col(f"`{text}`").alias("text"))
    held = common.checkpointed(_rows(given, ANCHOR, anchors))
    twice = held.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    wanted = held.join(shuffled(twice), "anchor").groupBy(F.col("doc_id").alias("d"), F.col("tie").alias("h")).agg(F.collect_set("anchor").alias("wanted"))
    wanted = shuffled(common.checkpointed(wanted))
    some = given.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("h"))).select("doc_id", "tie", "text", "wanted")
    gone = units.later(_rows(some, units.ROW, runs, "wanted"))
    own = F.col("doc_id").eqNullSafe(F.col("kept.id")) & (F.col("tie") == F.col("kept.tie"))
    gone = gone.filter(~own | (F.col("at") - F.col("kept.at") >= words)).select("doc_id", "tie", "at", "start", "end")  # equal rows of documents end in one run
    by = Window.partitionBy("doc_id", "tie").orderBy("at")
    gone = gone.withColumn("new", (F.coalesce(F.lag("at").over(by), F.lit(-words - 1)) + words < F.col("at")).cast("int")).withColumn("run", F.sum("new").over(by))
    first, n = F.min("at").alias("first_word"), (F.max("at") - F.min("at") + words).alias("n_words")
    return gone.groupBy("doc_id", "tie", "run").agg(first, n, F.min("start").alias("start"), F.max("end").alias("end")).select("doc_id", "first_word", "n_words", "start", "end", "tie")
