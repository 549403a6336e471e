"""Approximate nearest neighbours with a permutation index.

A vector is represented by the ordered list of its ``PREFIX`` nearest pivots; pivots are ``PIVOTS`` rows of a bounded sample. A shard of
the index holds up to ``SHARD_ROWS`` rows, dealt by hash, and for each pivot a posting list: the rows that have it in their lists, and at which place.
A query reads the postings of its own nearest pivots and so adds up the footrule distance of the lists to every row of the
shard (a pivot that a list lacks counts as the place after its last). The rows of the least footrule, a fraction ``depth`` of
the shard with all ties, are ranked again by their Euclidean distance on the original vectors, and the best k of all shards are merged.

``depth`` is fitted: for ``PROBES`` queries, chosen by hash, the true neighbours are found among all rows, and it is where
``RECALL`` of them come in their shards. Where lists tell nothing, it grows up to 1, an exact search. Every row is indexed and every
query sees every shard; queries come in blocks of ``QUERY_ROWS``, so a task holds one shard and one block at any size of the table.

Vectors that are null, empty or zero, hold a null or non-finite component or have no key take no part; vectors are compared with those of
their own length only. Rows that repeat a key are candidates of their own, but none for a query of that key; a query that is repeated with the same
vector counts once, with other vectors its best are merged. Ties go to the smaller key. No rows, queries or candidates give no rows.
Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import common

PIVOTS, PREFIX, SAMPLE = 256, 64, 4_096
SHARD_ROWS, QUERY_ROWS = 4_096, 2_048
PROBES, RECALL = 64, 0.97
SEED = 20_261
PACKED = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("places", pa.binary())])
DATA = "dim int, shard int, block int, ids binary, x binary, places binary"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def places_of(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """For each vector the place of each pivot in its list, ``prefix`` where it isn't in it."""
    n, m = len(x), len(pivots)
    order = np.argsort(squared(x, pivots), axis=1, kind="stable")[:, :prefix]
    out = np.full((n, m), prefix, np.uint16)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.uint16)[None, :], 1)
    return out


class Postings:
    """Posting lists of a shard: for each pivot its rows and their places."""

    def __init__(self, places: np.ndarray, prefix: int) -> None:
        self.n, self.prefix = len(places), prefix
        self.rows = [np.flatnonzero(own < prefix) for own in places.T]
        self.at = [own[rows].astype(np.int32) for own, rows in zip(places.T, self.rows, strict=True)]

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Footrule distance of the query's list to that of each row, less what is the same for all rows.

        With places a and b and ``prefix`` for those that a list lacks, a pivot that both have takes 2 (prefix - max(a, b)) off the sum
        of what either list would count alone.
        """
        out = np.zeros(self.n, np.int32)
        for p in np.flatnonzero(query < self.prefix):
            out[self.rows[p]] -= 2 * (self.prefix - np.maximum(self.at[p], np.int32(query[p])))
        return out


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(1))


def best(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least distances, ties to the smaller id."""
    if len(d) > k:
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    else:
        near = np.arange(len(d))
    return near[np.lexsort((ids[near], d[near]))][:k]


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and places of a shard or block."""
    x = np.frombuffer(row["x"], np.float64).reshape(-1, row["dim"])
    return np.frombuffer(row["ids"], np.int64), x, np.frombuffer(row["places"], np.uint16).reshape(len(x), -1)


class Index:
    """The distributed index over a table: shards of rows, blocks of queries, and the pivots on the driver (``PIVOTS`` vectors a length)."""

    def __init__(self, vectors: DataFrame, every: int, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> None:
        good = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null")
        good = good.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))
        sizes = {r["dim"]: (r["n"], r["asked"]) for r in good.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("id") % every == 0).cast("long")).alias("asked")).collect()}  # a row a length
        n = sum(v for v, _ in sizes.values())
        part = min(1.0, 2 * SAMPLE / max(1, n))
        drawn = good.filter(F.pmod(F.xxhash64("v", F.lit(SEED)), F.lit(1 << 30)) < int(part * (1 << 30)) + 1).dropDuplicates(["v"])
        sample: dict[int, list] = {}
        for r in drawn.orderBy(F.xxhash64("v", F.lit(SEED)), "v").limit(SAMPLE).collect():
            sample.setdefault(r["dim"], []).append(r["v"])
        self.pivots = {}
        for d, own in sample.items():
            own = np.array(sorted(own), float)
            self.pivots[d] = own[np.random.default_rng(SEED).permutation(len(own))[:pivots]]
        for d in sizes:
            self.pivots.setdefault(d, np.zeros((1, d)))
        self.prefix = prefix
        shards = {d: max(1, -(-n // shard_rows)) for d, (n, _) in sizes.items()}
        blocks = {d: -(-a // query_rows) for d, (_, a) in sizes.items()}
        self.shards, self.blocks = shards, blocks

        def number(of: dict[int, int]):
            return F.element_at(F.create_map(*[F.lit(v) for pair in of.items() for v in pair]), F.col("dim")) if of else F.lit(1)

        rows = good.withColumn("shard", F.pmod(F.xxhash64("id", "v"), number(shards)).cast("int")).withColumn("block", F.lit(-1))
        self.index = common.checkpointed(self._packed(rows))
        asked = good.filter(F.col("id") % every == 0).dropDuplicates(["id", "v"]).withColumn("block", F.pmod(F.xxhash64("v", "id"), F.greatest(number(blocks), F.lit(1))).cast("int")).withColumn("shard", F.lit(-1))
        self.queries = common.checkpointed(self._packed(asked))
        self.probes = self._packed(asked.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(PROBES).withColumn("block", F.lit(0)))

    def _packed(self, rows: DataFrame) -> DataFrame:
        """One row for each shard or block: ids, vectors, and the places of the pivots in their lists."""
        pivots, prefix = self.pivots, self.prefix

        def pack(table: pa.Table) -> pa.Table:
            d, shard, block = (table.column(c)[0].as_py() for c in ("dim", "shard", "block"))
            ids = table.column("id").to_numpy()
            x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            return pa.Table.from_pylist([{"dim": d, "shard": shard, "block": block, "ids": ids.tobytes(), "x": x.tobytes(), "places": places_of(x, pivots[d], prefix).tobytes()}], PACKED)

        return rows.select("dim", "shard", "block", "id", "v").groupBy("dim", "shard", "block").applyInArrow(pack, DATA)

    def visits(self, queries: DataFrame, blocks: dict[int, int] | None, made: str, visit) -> DataFrame:
        """``visit(index row, query row)`` for each shard and block; every task gets one of each."""

        def all_of(numbers: dict[int, int]):
            upto = F.element_at(F.create_map(*[F.lit(v) for pair in numbers.items() for v in pair]), F.col("dim")) if numbers else F.lit(0)
            return F.explode(F.when(upto > 0, F.sequence(F.lit(0), upto - 1)).otherwise(F.array().cast("array<int>")))

        own = self.index.withColumn("block", all_of(self.blocks if blocks is None else blocks)).withColumn("asks", F.lit(False))
        ask = queries.withColumn("shard", all_of(self.shards)).withColumn("asks", F.lit(True))

        def run(table: pa.Table) -> pa.Table:
            index, asks = (table.filter(pc.equal(table.column("asks"), v)).to_pylist() for v in (False, True))
            rows = [r for i in index for a in asks for r in visit(i, a)]
            names = [c.split()[0] for c in made.split(", ")]
            kinds = {"long": pa.int64(), "double": pa.float64()}
            return pa.table({n: pa.array([r[k] for r in rows], kinds[c.split()[1]]) for k, (n, c) in enumerate(zip(names, made.split(", "), strict=True))})

        return own.unionByName(ask).groupBy("dim", "shard", "block").applyInArrow(run, made)

    def fitted_depth(self, k: int, recall: float = RECALL) -> float:
        """The fraction of a shard that holds ``recall`` of the probes' true neighbours, by exact distances to all rows."""
        prefix = self.prefix

        def visit(index: dict, asks: dict) -> list[tuple]:
            ids, x, places = opened(index)
            postings, out = Postings(places, prefix), []
            for q, own, at in zip(*opened(asks), strict=True):
                d = distances(x, own)
                d[ids == q] = np.inf
                foot = postings.footrule(at)
                near = best(d, ids, k)
                near = near[np.isfinite(d[near])]
                order = np.sort(foot)
                out += [(int(q), int(ids[i]), float(d[i]), float(np.searchsorted(order, foot[i], "left") + 1) / len(x)) for i in near]
            return out

        found = self.visits(self.probes, {d: 1 for d in self.shards}, "query_id long, vec_id long, score double, depth double", visit)
        by = Window.partitionBy("query_id").orderBy("score", "vec_id")
        true = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        depths = sorted(r["depth"] for r in true.select("depth").collect())  # k rows a probe
        return depths[min(len(depths) - 1, int(recall * len(depths)))] if depths else 1.0

    def search(self, k: int = 10, depth: float | None = None) -> DataFrame:
        """(query_id, rank, vec_id, score): the k nearest found for each query."""
        depth = self.fitted_depth(k) if depth is None else depth
        prefix = self.prefix

        def visit(index: dict, asks: dict) -> list[tuple]:
            ids, x, places = opened(index)
            postings, out = Postings(places, prefix), []
            take = min(len(x), max(4 * k, int(np.ceil(depth * len(x)))))
            for q, own, at in zip(*opened(asks), strict=True):
                foot = postings.footrule(at)
                foot[ids == q] = 1  # after all others
                near = np.flatnonzero((foot <= np.partition(foot, take - 1)[take - 1]) & (ids != q))
                d = distances(x[near], own)
                out += [(int(q), int(ids[near[i]]), float(d[i])) for i in best(d, ids[near], k)]
            return out

        by = Window.partitionBy("query_id").orderBy("score", "vec_id")
        found = self.visits(self.queries, None, "query_id long, vec_id long, score double", visit)
        return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The k nearest rows found for each row whose key is divisible by ``every``, against all rows."""
    return Index(vectors, every).search(k)
