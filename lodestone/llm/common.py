"""Pieces that several operators share: reading tables, reliable checkpoints, word hashing, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import checkpointed as checkpointed

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def whole(docs: DataFrame, *columns: str) -> DataFrame:
    """All columns of ``docs`` as the struct ``row``, and some of them again: what is added beside can't clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(f"`{c}`") for c in dict.fromkeys(columns)])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- hashing of texts

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=U) * _ODD)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_UP = np.ones(1, U)
_DOWN = np.ones(1, U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        n = max(n, 1 << 20)
        _UP, _DOWN = (np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, b, U)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _UP[:n], _DOWN[:n]


def words_of(texts: pa.Array, fold: bool = True, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Hashes of all words, for runs of texts with about ``most`` bytes: (first, last, hash of each word, words of each text).

    Words are runs of anything but ASCII white space; with ``fold`` A-Z count as a-z. A null text has no words.
    """
    texts = texts.fill_null("").cast(pa.large_binary())
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + most, "right")) - 1)
        b, o = data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        if fold:
            b = np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)
        ink = ~((b == 32) | ((b >= 9) & (b <= 13)))
        opens, ends = ink.copy(), ink.copy()
        opens[1:] &= ~ink[:-1]
        ends[:-1] &= ~ink[1:]
        edge = np.unique(o[(o > 0) & (o < len(b))])
        opens[edge] = ink[edge]
        ends[edge - 1] = ink[edge - 1]
        at, to = np.flatnonzero(opens), np.flatnonzero(ends) + 1
        up, down = _powers(len(b) + 1)
        total = np.zeros(len(b) + 1, U)
        np.cumsum(_BYTES[b] * up[: len(b)], out=total[1:])
        yield first, last, mix((total[to] - total[at]) * down[at] + (to - at).astype(U)), np.diff(np.searchsorted(at, o))
        first = last


def shingles_of(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number for each text) of the distinct n-word shingles, sorted within each text.

    A text of 1 to n - 1 words has its whole sequence as its one shingle; a text without words has none.
    """
    starts = np.concatenate([[0], np.cumsum(counts)])
    size = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1)).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(starts[:-1] - begin[:-1], size) + np.arange(begin[-1])
    left = np.repeat(starts[1:], size) - at
    h = np.zeros(len(at), U)
    padded = np.concatenate([words, np.zeros(n, U)])
    for k in range(n):
        h = mix(h * _ODD + np.where(left > k, padded[at + k], U(0)) + U(k + 1))
    for s, e in zip(begin[:-1], begin[1:], strict=True):
        h[s:e].sort()
    owner = np.repeat(np.arange(len(counts)), size)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(counts))


# ---------------------------------------------------------------- connected components


#: Edges that one task of a round handles at least, and edges above which those of one node are split over tasks.
EDGES_A_TASK, HOT_EDGES = 100_000, 2_000_000
#: Edges that one task takes whole (8 MB), in place of rounds, each of which costs the driver plans, threads and broadcasts whatever it moves.
FEW_EDGES = 500_000


def merged(src: np.ndarray, dst: np.ndarray, m: int) -> np.ndarray:
    """Smallest row of the component of each of m rows."""
    root = np.arange(m)
    while len(src):
        a, b = root[src], root[dst]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    return root


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (u, v) of a task."""
    edges = [np.stack([b.column("u").to_numpy(), b.column("v").to_numpy()]) for b in batches]
    if edges:
        nodes, at = np.unique(np.concatenate(edges, axis=1), return_inverse=True)
        src, dst = at.reshape(2, -1)
        root = nodes[merged(src, dst, len(nodes))]
        for s in range(0, len(nodes), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[s : s + 10_000]), pa.array(root[s : s + 10_000])], ["node", "component"])
    release()


def components(edges: DataFrame, most_rounds: int = 40, hot: int = HOT_EDGES, few: int = FEW_EDGES) -> DataFrame:
    """(node, component) for the undirected graph of ``edges`` (src, dst: long); a component is named by its smallest node.

    Up to ``few`` edges are joined by one task. More alternate large-star and small-star steps, each an aggregation and a join, until they no longer change. Rounds use as many
    tasks as the edges need, since every task of a round leaves files. Nodes without an edge are not returned;
    loops and repeated edges are allowed. No edges give no rows.
    """
    e = checkpointed(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    n = e.count()
    if n <= few:
        return e.coalesce(1).mapInArrow(_joined, "node long, component long")
    tasks = max(8, -(-n // EDGES_A_TASK))
    e, seen = e.coalesce(tasks), None

    def least(edges: DataFrame) -> DataFrame:
        """The least neighbour of each node. Grouped by a second key, it is shuffled again for the join by node, whose sides
        are so both plain shuffles: a node with very many edges is split over tasks. Few edges do without."""
        keys = ["u", F.xxhash64("u").alias("z")] if n > hot else ["u"]
        return edges.groupBy(*keys).agg(F.min("v").alias("m")).select("u", "m")

    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        low = least(e)
        e = e.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        e = checkpointed(e)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


# ---------------------------------------------------------------- columns computed from whole texts

#: Rows that are Python objects at a time.
SLICE = 1_000


def release() -> None:
    """Gives free memory of this Python worker back: workers are kept from one stage to the next, and so is what they hold."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def add_columns(docs: DataFrame, text: str | tuple[str, str], made: str, start, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or those of ``keep``) with the columns of the schema ``made``, computed from a text column in Python.

    ``start()`` is called once a task and returns a function from a list of texts (None for null) to a list of Arrow arrays,
    one for each new column. Column names may hold any characters or clash with nothing but those of ``made``. A text that is kept, itself
    or as a field (struct, field), is sent to Python once.
    """
    from pyspark.sql import types as T

    new = T.StructType.fromDDL(made)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    names = [f"c{k}" for k in range(len(keep))]
    column, field = text if isinstance(text, tuple) else (text, None)
    own = names[keep.index(column)] if column in keep else "t"
    given = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], *([] if column in keep else [F.col(f"`{column}`").alias("t")]))
    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for c, n in zip(keep, names, strict=True)] + list(new))

    def run(batches):
        release()  # what earlier tasks left
        f = start()
        for batch in batches:
            for s in range(0, batch.num_rows, SLICE):
                part = batch.slice(s, SLICE)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *f((part.column(own) if field is None else part.column(own).field(field)).to_pylist())], [*names, *new.names])
            release()

    return given.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *new.names)
