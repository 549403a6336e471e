"""Exact top-k search by inner product: a ball tree in each shard, searched by branch and bound.

Rows are dealt into shards by space: each goes to the nearest of the pivots, centres of a small tree over a bounded sample; a cell of
more than ``SHARD_ROWS`` rows (as of equal vectors) is cut by hash. Each shard's tree is built once and stored. It halves its rows along
the line between two far points; a node keeps its centre and radius, so that q.centre + |q| * radius bounds the product of q with
all of its rows. Blocks of queries go down a tree together: at each node the queries whose bound is below their current k-th score
drop out, children are visited in the order of their bounds, and leaves are scored exactly. The current k-th score is
shared: a first pass searches the shard of each query's highest bound, and only shards whose bound reaches the k-th score found there
are sent the query, which starts with that score. The best k of all shards are merged.

A component x counts as floor(256 * x), x as double; products are exact integers, those out of the range of long cut to it before they are ranked.
Vectors that are null, hold a null or non-finite component, or have no vec_id take no part. Vectors are
compared with those of their own length only. Rows that repeat a vec_id are candidates of their own, but none for a query of
that vec_id; a query that is repeated with the same vector counts once, and with other vectors its best scores are merged.
Ties go to the smaller vec_id. A table without rows, queries or candidates gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import common

LEAF = 64
SHARD_ROWS = 16_384
#: Least number of shards, most pivots, and rows of the sample for each pivot.
SHARDS, PIVOTS, SAMPLE = 16, 1_024, 16
BLOCK = 1_024
#: Balls of all shards are compared with the queries up to so many bytes; beyond, every query goes to every shard.
BALL_BYTES = 64 << 20
LONG = (1 << 63) - 1
TREE = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in ("ids", "x", "nodes", "centre", "radius", "ball"))])


class Tree:
    """Rows in tree order, and nodes (first row, end, children, centre, radius)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(x))
        self.nodes: list[tuple[int, int, tuple[int, int] | None]] = []
        self.centre, self.radius = [], []
        self._grow(x, 0, len(x), leaf)

    def _grow(self, x: np.ndarray, s: int, e: int, leaf: int) -> int:
        own = x[self.order[s:e]]
        c = own.mean(0)
        d = np.sqrt(((own - c) ** 2).sum(1))
        node = len(self.nodes)
        self.nodes.append((s, e, None))
        self.centre.append(c)
        self.radius.append(float(d.max()))
        if e - s > leaf and d.max() > 0:
            a = own[d.argmax()]
            da = ((own - a) ** 2).sum(1)
            b = own[da.argmax()]
            side = da - ((own - b) ** 2).sum(1)
            m = (e - s) // 2
            part = np.argpartition(side, m)
            self.order[s:e] = self.order[s:e][part]
            self.nodes[node] = (s, e, (self._grow(x, s, s + m, leaf), self._grow(x, s + m, e, leaf)))
        return node


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """q times x transposed, of whole numbers held as doubles."""
    top = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0))
    if top**2 * max(1, q.shape[1]) < 2**53:
        return q @ x.T
    big = np.array([[int(v) for v in r] for r in q], object).reshape(q.shape) @ np.array([[int(v) for v in r] for r in x], object).reshape(x.shape).T
    return np.minimum(np.maximum(big, -LONG - 1), LONG)


def bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """What the products of queries (rows) with the vectors in balls (columns) can't exceed, rounding allowed for."""
    norm = np.sqrt((q * q).sum(1))
    out = q @ centre.T + norm[:, None] * radius[None, :]
    return out + 1e-9 * (np.abs(out) + norm[:, None] * np.sqrt((centre * centre).sum(1))[None, :] + 1)


def slack(v: np.ndarray) -> np.ndarray:
    """A double may be above the long it stands for."""
    return np.where(np.isfinite(v), v - np.abs(v) * 1e-12, v)


def search(tree: Tree, x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, start: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, row id, score): the best k rows, given in the tree's order, for each query; those below ``start`` left out."""
    bound = bounds(q, np.array(tree.centre), np.array(tree.radius))
    kth = slack(start.astype(float))
    best: list[list[tuple[int, int]]] = [[] for _ in q]
    todo = [(0, np.arange(len(q)))]
    while todo:
        node, active = todo.pop()
        active = active[bound[active, node] >= kth[active]]
        if not len(active):
            continue
        s, e, children = tree.nodes[node]
        if children:
            a, b = sorted(children, key=lambda c: bound[active, c].sum())
            todo += [(a, active), (b, active)]  # the higher bound is taken first
            continue
        scores = exact_products(q[active], x[s:e])
        hits = (scores >= kth[active][:, None]) & (ids[s:e][None, :] != qids[active][:, None])
        for r in np.flatnonzero(hits.any(1)):
            i, hit = active[r], np.flatnonzero(hits[r])
            best[i] = sorted(best[i] + [(-int(scores[r, h]), int(ids[s + h])) for h in hit])[:k]
            if len(best[i]) == k:
                kth[i] = max(kth[i], slack(np.array(float(-best[i][-1][0]))))
    return [(i, row, -score) for i, own in enumerate(best) for score, row in own]


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as 32-bit integers if they fit, else as doubles; the first byte tells."""
    small = np.abs(x).max(initial=0) < 2**31
    return (b"i" + x.astype(np.int32).tobytes()) if small else b"d" + x.astype(np.float64).tobytes()


def unpacked(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if data[:1] == b"i" else np.float64, offset=1).astype(np.float64).reshape(-1, dim)


def pivots_of(x: np.ndarray, n: int) -> np.ndarray:
    """At most n centres of the leaves of a tree over a sample."""
    tree = Tree(x, max(1, len(x) // max(1, n)))
    leaves = [i for i, (_, _, c) in enumerate(tree.nodes) if c is None]
    return np.array(tree.centre)[leaves]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", shards: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose key is divisible by ``every``, against all rows."""
    good = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null and size(v) > 0").filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    good = good.withColumn("dim", F.size("v"))
    n = good.count()
    n_pivots = shards or min(PIVOTS, max(SHARDS, -(-n // SHARD_ROWS)))
    part = min(1.0, SAMPLE * n_pivots / max(1, n))
    picked = good.filter(F.pmod(F.xxhash64("id", F.hash("v")), F.lit(1 << 30)) < int(part * (1 << 30)) + 1)
    sample: dict[int, list] = {}
    for r in picked.select("dim", "v").limit(4 * SAMPLE * n_pivots).collect():  # about SAMPLE rows a pivot
        sample.setdefault(r["dim"], []).append(r["v"])
    pivots = {d: pivots_of(np.floor(256 * np.array(v, np.float64)), n_pivots) for d, v in sample.items()}

    def whole(batch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Rows of a batch and their vectors in whole numbers, by length."""
        dims = batch.column("dim").to_numpy()
        out = {}
        for d in np.unique(dims):
            own = np.flatnonzero(dims == d)
            v = batch.column("v").take(pa.array(own))
            out[int(d)] = own, np.floor(256 * v.flatten().to_numpy().astype(np.float64).reshape(-1, d))
        return out

    def nearest(batches):
        for batch in batches:
            cell, held = np.zeros(batch.num_rows, np.int32), [b""] * batch.num_rows
            for d, (own, x) in whole(batch).items():
                c = pivots.get(d)
                if c is not None:
                    cell[own] = (((c * c).sum(1)[None, :]) - 2 * (x @ c.T)).argmin(1)
                for i, v in zip(own.tolist(), x, strict=True):
                    held[i] = packed(v)
            yield pa.RecordBatch.from_arrays([batch.column("dim"), pa.array(cell), batch.column("id"), pa.array(held, pa.binary())], ["dim", "cell", "id", "x"])

    rows = good.select("dim", "id", "v").mapInArrow(nearest, "dim int, cell int, id long, x binary")
    sizes = rows.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("parts"))  # at most PIVOTS rows a length
    rows = rows.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "x"), F.col("parts")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        d = table.column("dim")[0].as_py()
        x = np.concatenate([unpacked(v, d) for v in table.column("x").to_pylist()])
        tree = Tree(x)
        nodes = np.array([(s, e, *(c or (-1, -1))) for s, e, c in tree.nodes], np.int64)
        one = {"dim": d, "cell": table.column("cell")[0].as_py(), "part": table.column("part")[0].as_py(), "ids": table.column("id").to_numpy()[tree.order].tobytes(), "x": packed(x[tree.order])}
        one |= {"nodes": nodes.tobytes(), "centre": np.array(tree.centre).tobytes(), "radius": np.array(tree.radius).tobytes(), "ball": np.array([*tree.centre[0], tree.radius[0]]).tobytes()}
        return pa.Table.from_pylist([one], TREE)

    trees = common.checkpointed(rows.groupBy("dim", "cell", "part").applyInArrow(build, "dim int, cell int, part int, ids binary, x binary, nodes binary, centre binary, radius binary, ball binary"))
    queries = common.checkpointed(good.filter(F.col("id") % every == 0).dropDuplicates(["id", "v"]))
    balls: dict[int, tuple[list, np.ndarray, np.ndarray]] = {}
    total = trees.agg(F.coalesce(F.sum(F.octet_length("ball")), F.lit(0))).first()[0]
    pruned = total <= BALL_BYTES
    found: dict[int, list] = {}
    for r in trees.select("dim", "cell", "part", "ball" if pruned else F.lit(None).alias("ball")).collect():  # a row a shard
        found.setdefault(r["dim"], []).append(((r["cell"], r["part"]), np.frombuffer(r["ball"]) if pruned else np.append(np.zeros(r["dim"]), np.inf)))
    for d, own in found.items():
        m = np.array([b for _, b in own])
        balls[d] = [s for s, _ in own], m[:, :-1], m[:, -1]
    shared = queries.sparkSession.sparkContext.broadcast(balls)

    def send(batches, first: bool):
        """Blocks of queries by shard: that of the highest bound, or all others whose bound reaches the k-th score."""
        for batch in batches:
            for d, (own, q) in whole(batch).items():
                names, centre, radius = shared.value[d]
                for s in range(0, len(own), BLOCK):
                    at, x = own[s : s + BLOCK], q[s : s + BLOCK]
                    bound = bounds(x, centre, np.where(np.isfinite(radius), radius, 0.0))
                    home = bound.argmax(1)
                    ids = batch.column("id").to_numpy()[at]
                    start = np.full(len(at), -np.inf)
                    if first:
                        wanted = np.zeros(bound.shape, bool)
                        wanted[np.arange(len(at)), home] = True
                    else:
                        start = batch.column("kth").to_numpy(zero_copy_only=False)[at].astype(float)
                        start = np.where(np.isnan(start), -np.inf, start)
                        wanted = (bound >= slack(start)[:, None]) | ~np.isfinite(radius)[None, :]
                        wanted[np.arange(len(at)), home] = False
                    full = np.flatnonzero(wanted.any(0))
                    some = [np.flatnonzero(wanted[:, c]) for c in full]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d] * len(full), pa.int32()), *(pa.array([names[c][i] for c in full], pa.int32()) for i in (0, 1)), pa.array([ids[w].tobytes() for w in some], pa.binary()), pa.array([packed(x[w]) for w in some], pa.binary()), pa.array([start[w].tobytes() for w in some], pa.binary())],
                        ["dim", "cell", "part", "qid", "q", "start"],
                    )

    def scan(given: DataFrame, first: bool) -> DataFrame:
        asked = given.mapInArrow(lambda batches: send(batches, first), "dim int, cell int, part int, qid binary, q binary, start binary")
        both = trees.drop("ball").unionByName(asked, allowMissingColumns=True)

        def visit(table: pa.Table) -> pa.Table:
            out: list[tuple[int, int, int]] = []
            own, asks = table.filter(pa.compute.is_valid(table.column("x"))).to_pylist(), table.filter(pa.compute.is_valid(table.column("q")))
            if own and asks.num_rows:
                one, d = own[0], own[0]["dim"]
                tree = Tree.__new__(Tree)
                tree.nodes = [(s, e, None if a < 0 else (a, b)) for s, e, a, b in np.frombuffer(one["nodes"], np.int64).reshape(-1, 4).tolist()]
                tree.centre, tree.radius = np.frombuffer(one["centre"]).reshape(-1, d), np.frombuffer(one["radius"])
                x, ids = unpacked(one["x"], d), np.frombuffer(one["ids"], np.int64)
                for qid, q, start in zip(*(asks.column(c).to_pylist() for c in ("qid", "q", "start")), strict=True):
                    qids = np.frombuffer(qid, np.int64)
                    out += [(int(qids[i]), row, score) for i, row, score in search(tree, x, ids, unpacked(q, d), qids, np.frombuffer(start), k)]
            return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.int64())})

        return both.groupBy("dim", "cell", "part").applyInArrow(visit, "query_id long, vec_id long, score long")

    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    home = common.checkpointed(scan(queries.select("dim", "id", "v"), True))
    kth = home.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("kth"))
    rest = scan(queries.join(kth, "id", "left").select("dim", "id", "v", "kth"), False)
    return home.unionByName(rest).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
