"""Substring dedup by hashing of units, and line dedup by overlapping windows. Both keep the earliest occurrence.

Places are code points from 0, ends exclusive, so removed text is found in the original. Digests have 128 bits. An occurrence's rank
is (doc_id, hash of the text, place in the text); a null doc_id ranks last and so never takes text from a document with one.
Null and empty texts have no units. Rows equal in doc_id and text are one text: what goes from it is returned for each of them.

Words are runs of anything but ASCII white space. All steps are linear in the length of a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import common

WINDOW = 3
SPACE = " \t\n\x0b\x0c\r"
WORDS = re.compile(f"[^{SPACE}]+")
#: White space of other kinds, which str.split would split at as well.
OTHER_SPACE = re.compile(r"[^\S \t\n\x0b\x0c\r]")
#: A sentence of a line ends with a full stop, question mark or exclamation mark before a space or tab.
STOP = re.compile(r"[.!?](?=[ \t])")
ROW = "doc_id long, tie long, at int, start long, end long, a long, b long"
#: Repeated digests of at most so many rows are sent to every executor; above, both sides are shuffled and skewed keys split.
SEND_ROWS = 200_000


def _digest(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def pieces_of(text: str) -> Iterator[tuple[int, str]]:
    """(start, piece) of each line, and after it of its sentences if it holds more than one."""
    at = 0
    for line in text.split("\n"):
        yield at, line
        cuts = [0, *(m.end() for m in STOP.finditer(line)), len(line)]
        if len(cuts) > 2:
            bare = line.strip(SPACE)
            yield from ((at + s, line[s:e]) for s, e in zip(cuts, cuts[1:]) if line[s:e].strip(SPACE) != bare)
        at += len(line) + 1


def units_of(text: str, min_words: int = 1) -> Iterator[tuple[int, int, int, int, int]]:
    """(unit, start, end, digest halves) of lines and sentences with enough words, compared in lower case and with single spaces."""
    k = 0
    words_of = WORDS.findall if OTHER_SPACE.search(text) else str.split
    for begin, piece in pieces_of(text):
        words = words_of(piece)
        if words and len(words) >= min_words:
            start = begin + len(piece) - len(piece.lstrip(SPACE))
            yield k, start, begin + len(piece.rstrip(SPACE)), *_digest(" ".join(words).lower().encode())
        k += bool(words)


def windows_of(text: str, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(first line, start, end, digest halves) of the windows that aren't blank; white space around a line doesn't count."""
    lines = text.split("\n")
    starts, at = [], 0
    for x in lines:
        starts.append(at)
        at += len(x) + 1
    bare = [x.strip() for x in lines]
    held = [hashlib.blake2b(x.encode(), digest_size=16).digest() for x in bare]
    for k in range(len(lines) - window + 1):
        if any(bare[k : k + window]):
            yield k, starts[k], starts[k + window - 1] + len(lines[k + window - 1]), *_digest(b"".join(held[k : k + window]))


def occurrences(docs: DataFrame, cut: Callable[[str], Iterator[tuple]], key: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, tie, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "text")), strict=True):
                for found in cut(t or ""):
                    for c, v in zip(cols, (doc, tie, *found), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "tie", "at", "start", "end", "a", "b"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), _tie(text), F.col(text).alias("text")).mapInArrow(run, ROW)


def _tie(text: str) -> Column:
    return F.xxhash64(F.col(f"`{text}`")).alias("tie")


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "tie", "at")


def later(found: DataFrame) -> DataFrame:
    """``found`` without each digest's earliest place, with that place as ``kept``."""
    first = common.checkpointed(found.groupBy("a", "b").agg(F.min(_place()).alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    return found.join(F.broadcast(first) if first.count() <= SEND_ROWS else first, ["a", "b"]).filter(~_place().eqNullSafe(F.col("kept")))


def repeated_units(docs: DataFrame, min_words: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, unit, start, end, kept_doc_id, kept_unit, tie) for each unit of at least ``min_words`` words that an earlier place holds as well.

    ``tie`` is the hash of the text, which tells the texts of a repeated doc_id apart.
    """
    gone = later(occurrences(docs, lambda t: units_of(t, min_words), key, text))
    return gone.select("doc_id", F.col("at").alias("unit"), "start", "end", F.col("kept.id").alias("kept_doc_id"), F.col("kept.at").alias("kept_unit"), "tie")


def repeated_windows(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, first_line, last_line, start, end, tie) of the runs of lines that go.

    The lines of a window that an earlier place holds are covered; covered windows that touch or overlap are one run.
    A text of fewer lines than a window has none.
    """
    gone = later(occurrences(docs, lambda t: windows_of(t, window), key, text)).dropDuplicates(["doc_id", "tie", "at"])
    by = Window.partitionBy("doc_id", "tie").orderBy("at")
    runs = gone.withColumn("new", (F.coalesce(F.lag("at").over(by), F.lit(-window - 1)) + window < F.col("at")).cast("int")).withColumn("run", F.sum("new").over(by))
    return runs.groupBy("doc_id", "tie", "run").agg(F.min("at").alias("first_line"), (F.max("at") + window - 1).alias("last_line"), F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def without(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, the texts without the (doc_id, tie, start, end) of ``spans``, which may overlap."""
    from pyspark.sql import types as T

    gone = spans.groupBy(F.col("doc_id").alias("d"), F.col("tie").alias("h")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("gone"))
    names = [f"c{k}" for k in range(len(docs.columns))]
    given = docs.select(F.col(f"`{key}`").cast("long").alias("key"), _tie(text), *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    given = given.join(gone, F.col("key").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("h")), "left").select(*names, "gone")
    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for c, n in zip(docs.columns, names, strict=True)])
    k = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            out = []
            for t, spans in zip(batch.column(k).to_pylist(), batch.column("gone").to_pylist(), strict=True):
                at, kept = 0, []
                for s in spans or ():
                    kept.append((t or "")[at : s["start"]])
                    at = max(at, s["end"])
                out.append(t if not spans else "".join(kept) + t[at:])
            yield pa.RecordBatch.from_arrays([batch.column(n) if i != k else pa.array(out, pa.string()) for i, n in enumerate(names)], names)

    return given.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
