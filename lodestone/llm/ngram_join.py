"""N-gram Jaccard join: blocked sparse matrix product of document by n-gram incidence.

The incidence matrix has a row for each different shingle set and a column for each shingle. The
product of the matrix with its transpose holds all overlaps, of which only those count that reach the
threshold. It is taken block by block, and blocks without such an overlap are never formed:

1. Sets of equal content are one row (``classes``): exact copies are linked through their row, and only its
   representative is worked on.
2. By the sizes alone, two sets at or over the threshold differ in at most D shingles, where D follows from
   the larger size that their size group allows. Columns are dealt by hash into D + 1 stripes, so such a pair agrees
   in whole stripes. A row emits a fingerprint for its stripes that hold at least 1 to 3 shingles; rows with the same
   fingerprint go into the same block. Of large sets the first ``STRIPES`` stripes do, small sets deal the columns
   anew until they have as many. A stripe of a pair just at the threshold agrees and is full enough with a probability of
   over 1/3, so a link is overlooked with a probability of about 1e-11, whatever the texts and their number.
   Rows of one Arrow batch with the same fingerprint are joined there; only one of them goes into the shuffle.
3. Blocks of more than ``CHUNK`` rows (or ``CHUNK_BYTES``) are cut again by an exact rule: two linked sets share a shingle among
   their first n - ceil(n * num / den) + 1 shingles in any order that holds for both. The order is by a counting sketch of fixed
   size (rare shingles first), and a shingle that the sketch has seen once has no partner.
4. A block that is still too large holds texts that are alike. It is cut into chunks by size group and hash. Each is multiplied with
   itself and with a few leading rows of its block, those of the most frequent shingles and some by hash. Only rows
   outside the largest component that these links make go on to be multiplied with the chunks of their own size group and the next ones.
5. In a task, columns with one row are dropped and the rest is multiplied in slices, accumulating overlap counts; a pair
   whose count can no longer reach what its two sizes ask for is discarded between slices. A spanning forest of the links
   leaves the task, not the pairs.

Shingles are compared by 64-bit fingerprints. Null or word-less text: empty set, linked with nothing, its own component.
One row is returned for each input row; rows that repeat a doc_id are joined with it, as a doc_id names one document
with the union of their links. A null doc_id is kept, never linked, with null as its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import common
from lodestone.llm.common import U, mix
from lodestone.session import shuffled

#: Most rows and bytes of shingles of a block that is one task.
CHUNK, CHUNK_BYTES = 256, 4 << 20
STRIPES, DEALINGS = 64, 13
#: Leading rows of a large block: fewer than so many, half by score and a quarter by hash, with about so many shingles in all.
LEADERS, LEADER_SHINGLES = 32, 1 << 17
#: Counters of the sketch that orders shingles, in parts of so many.
SKETCH_BITS, PART_BITS = 21, 12
#: Representatives that share one bucket of fingerprints.
BUCKET_ROWS = 2_000
#: Rows of the second side of a join that may be sent to every executor, and of one of a single column; above, both sides are shuffled.
#: The driver holds several times the bytes that it sends: at 390,000 rows of seven columns it grew by some 240 MB.
SEND_ROWS, SEND_IDS = 50_000, 200_000


class Threshold:
    """Jaccard similarity of at least num/den, and what sizes alone say about it."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(bounds[-1] * den // num + 1)
        bounds += [bounds[-1] * 2, bounds[-1] * 4, bounds[-1] * 8]
        self.lows = np.array(bounds)  # step s holds sizes lows[s] to lows[s+1] - 1; a partner is in s or beside it

    def step(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, n, "right") - 1

    def stripes(self, group: np.ndarray) -> np.ndarray:
        """One more than the most shingles in which a pair can differ, neither size above the two steps of a group."""
        total = 2 * (self.lows[2 * group + 2] - 1)
        return total * (self.den - self.num) // (self.den + self.num) + 1

    def need(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least overlap of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """So many first shingles of two linked sets have one in common."""
        return n - -(-n * self.num // self.den) + 1


def fingerprints(h: np.ndarray, counts: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, row) of the rows' stripes: in their own size group, and in the next one where a partner may be in that."""
    step = t.step(np.maximum(counts, 1))
    sigs, rows = zip(*[_stripes(h, counts, t, g, own) for g, own in ((step // 2, counts > 0), (step // 2 + 1, (counts > 0) & (step % 2 == 1)))], strict=True)
    return np.concatenate(sigs), np.concatenate(rows)


def _stripes(h: np.ndarray, counts: np.ndarray, t: Threshold, g: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = t.stripes(g)
    need = np.clip(counts // (2 * k), 1, 3)
    dealings = np.minimum(DEALINGS, -(-STRIPES // k))
    sigs, owners = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for deal in range(1, DEALINGS + 1):
        # with one stripe only equal sets match, and these are one row already
        use = own & (k > 1) & (dealings >= deal)
        rows = np.flatnonzero(use)
        if not len(rows):
            break
        x = mix(h[np.repeat(use, counts)] + U(deal * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        owner, kept = np.repeat(np.arange(len(rows)), counts[rows]), np.minimum(k[rows], STRIPES)
        off = np.concatenate([[0], np.cumsum(kept)])
        stripe = (((x >> U(32)) * k[rows][owner].astype(U)) >> U(32)).astype(np.int64)
        inside = stripe < STRIPES
        slot, y, n = (off[owner] + stripe)[inside], mix(x[inside]), int(off[-1])
        lo = np.bincount(slot, (y & U(0xFFFFFFFF)).astype(np.float64), n).astype(U)
        hi = np.bincount(slot, (y >> U(32)).astype(np.float64), n).astype(U)
        who = np.repeat(np.arange(len(rows)), kept)
        place = (np.arange(n) - off[who]).astype(U) + (g[rows][who].astype(U) << U(20)) + U(deal << 16)
        full = np.bincount(slot, minlength=n) >= need[rows][who]
        sigs.append(mix(lo + (hi << U(32)) + mix(place))[full])
        owners.append(rows[who][full])
    return np.concatenate(sigs), np.concatenate(owners)


def prefixes(h: np.ndarray, counts: np.ndarray, t: Threshold, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, row) of the rows' first shingles in the order of the sketch, without those that no other row has."""
    seen, owner = sketch[_slots(h)], np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, seen, owner))
    place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    use = order[(place < np.repeat(t.prefix(counts), counts)) & (seen[order] > 1)]
    return mix(h[use]), owner[use]


def _slots(h: np.ndarray) -> np.ndarray:
    return (mix(h + U(21)) >> U(64 - SKETCH_BITS)).astype(np.int64)


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, shingles, number for each row), in runs of bounded bytes."""
    for first, last, words, counts in common.words_of(batch.column("text")):
        yield batch.slice(first, last - first), *common.shingles_of(words, counts, n)


def _set_keys(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit fingerprints of each set."""
    owner, out = np.repeat(np.arange(len(counts)), counts), []
    for salt in (11, 12):
        y = mix(h + U(salt))
        lo = np.bincount(owner, (y & U(0xFFFFFFFF)).astype(np.float64), len(counts)).astype(U)
        hi = np.bincount(owner, (y >> U(32)).astype(np.float64), len(counts)).astype(U)
        out.append(mix(lo + (hi << U(32)) + counts.astype(U)).view(np.int64))
    return out[0], out[1]


def overlaps(h: np.ndarray, counts: np.ndarray, left: np.ndarray, t: Threshold, width: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Links (row of ``left``, row): incidence times its transpose, in slices of columns, for pairs that can still reach their bound."""
    m = len(counts)
    ids, col, df = np.unique(h, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), counts)
    order = np.argsort(col, kind="stable")
    order = order[df[col[order]] > 1]
    col, owner = col[order], owner[order]
    _, col = np.unique(col, return_inverse=True)
    to_come = np.bincount(owner, minlength=m)
    need = t.need(counts[left][:, None], counts[None, :])
    out = np.zeros((len(left), m), np.int64)
    possible = np.minimum(to_come[left][:, None], to_come[None, :]) >= need
    possible[np.arange(len(left)), left] = False
    edges = np.searchsorted(col, np.arange(0, (col[-1] + 1 if len(col) else 0) + width, width))
    for i, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        rows, others = np.flatnonzero(possible.any(1)), np.flatnonzero(possible.any(0))
        if not len(rows):
            break
        x = np.zeros((m, width), np.float32)
        x[owner[s:e], col[s:e] - i * width] = 1
        out[np.ix_(rows, others)] += (x[left[rows]] @ x[others].T).astype(np.int64)
        to_come -= np.bincount(owner[s:e], minlength=m)
        possible &= out + np.minimum(to_come[left][:, None], to_come[None, :]) >= need
    return np.nonzero(possible)


def _forest(table: pa.Table, left: np.ndarray | None, t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (src, dst) of the links of some rows of a block (all: None) with all of its rows."""
    ids, counts = table.column("rep").to_numpy(), table.column("n").to_numpy().astype(np.int64)
    left = np.arange(len(ids)) if left is None else left
    a, b = overlaps(np.frombuffer(b"".join(table.column("h").to_pylist()), U), counts, left, t)
    root = common.merged(left[a], b, len(ids))
    moved = np.flatnonzero(root != np.arange(len(ids)))
    if table.nbytes > 1 << 20:
        common.release()
    return ids[moved], ids[root[moved]]


def _starred(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One row of each fingerprint (fingerprints, rows), and edges (src, dst) from it to the others."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    lead = node[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))] if len(sig) else node
    pairs = np.unique(np.stack([lead, node], 1)[lead != node], axis=0)
    return sig[first], node[first], pairs[:, 0], pairs[:, 1]


class Job:
    """One join: the texts, the threshold, and the passes over texts that its steps need."""

    def __init__(self, docs: DataFrame, words: int, t: Threshold, rows: int) -> None:
        self.docs, self.words, self.t = docs, words, t
        self.bits = max(6, (rows // BUCKET_ROWS).bit_length())

    def texts(self, ids: DataFrame, n: int) -> DataFrame:
        """Texts of some rows; ``ids`` has the representative as doc_id, and whatever goes along."""
        return self.docs.join(F.broadcast(ids) if n <= SEND_ROWS else shuffled(ids), "doc_id")

    def narrow(self, ids: DataFrame) -> None:
        """From here on texts of ``ids`` are asked for only. If they are too many to be sent, all texts are shuffled this once, and later joins shuffle those that are left."""
        ids = ids.select("doc_id").distinct()
        if ids.count() > SEND_ROWS:
            self.docs = common.checkpointed(self.docs.join(shuffled(ids), "doc_id", "left_semi"))

    def meeting(self, given: DataFrame, sigs) -> DataFrame:
        """(node, component): the blocks of rows that share one of the fingerprints that ``sigs`` makes."""
        words, bits = self.words, self.bits

        def emit(batches):
            for batch in batches:
                found = [(sig, _set_keys(h, counts)[0][row]) for _, h, counts in _sets(batch, words) for sig, row in (sigs(h, counts),)]
                if found:
                    sig, node, src, dst = _starred(*(np.concatenate(x) for x in zip(*found, strict=True)))
                    cut = [_dealt(sig, bits, sig, node), _dealt(mix(src.view(U)), bits, src, dst)]
                    full = sorted({*cut[0], *cut[1]})
                    none = (b"", b"")
                    columns = [pa.array([c.get(i, none)[k] for i in full], pa.binary()) for c in cut for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *columns], ["bucket", "sig", "node", "src", "dst"])
                common.release()

        def meet(table: pa.Table) -> pa.Table:
            sig, node, src, dst = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("sig", "node", "src", "dst"))
            _, _, more, to = _starred(sig, node)
            pairs = np.unique(np.stack([np.concatenate([src, more]), np.concatenate([dst, to])], 1), axis=0)
            common.release()
            return pa.table({"src": pairs[:, 0], "dst": pairs[:, 1]})

        edges = given.mapInArrow(emit, "bucket int, sig binary, node binary, src binary, dst binary").groupBy("bucket").applyInArrow(meet, "src long, dst long")
        return common.components(edges)

    def sketch(self, given: DataFrame):
        """A broadcast of 4 MB: counts of shingles by slot, never below the truth but for the cap of 65,535."""
        words, size, spark = self.words, 1 << PART_BITS, given.sparkSession

        def count(batches):
            total = np.zeros(1 << SKETCH_BITS, np.int64)
            for batch in batches:
                for _, h, _ in _sets(batch, words):
                    total += np.bincount(_slots(h), minlength=len(total))
            parts = total.reshape(-1, size)
            full = np.flatnonzero(parts.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([np.minimum(parts[i], 65535).astype(np.uint16).tobytes() for i in full], pa.binary())], ["part", "seen"])
            common.release()

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, np.uint16).astype(np.int64) for x in table.column("seen").to_pylist())
            return pa.table({"part": table.column("part").slice(0, 1), "seen": pa.array([np.minimum(total, 65535).astype(np.uint16).tobytes()], pa.binary())})

        out = np.zeros((1 << SKETCH_BITS - PART_BITS, size), np.uint16)
        for r in given.mapInArrow(count, "part int, seen binary").groupBy("part").applyInArrow(add, "part int, seen binary").collect():  # 512 rows of 8 KB at most
            out[r["part"]] = np.frombuffer(r["seen"], np.uint16)
        return spark.sparkContext.broadcast(out.reshape(-1))

    def incidence(self, ids: DataFrame, n: int, keep: list[str], repeated: bool) -> DataFrame:
        """``keep``, rep, n and the sorted shingles h of the rows ``ids`` (doc_id, a, b and ``keep``)."""
        words = self.words
        kinds = {f.name: f.dataType.simpleString() for f in ids.schema}

        def run(batches):
            for batch in batches:
                for part, h, counts in _sets(batch, words):
                    a, b = _set_keys(h, counts)
                    cuts = np.concatenate([[0], np.cumsum(counts)])
                    good = np.flatnonzero((a == part.column("a").to_numpy()) & (b == part.column("b").to_numpy()))
                    own = part.take(pa.array(good))
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in keep), own.column("doc_id"), pa.array(counts[good], pa.int64()), pa.array([h[cuts[i] : cuts[i + 1]].tobytes() for i in good], pa.binary())], [*keep, "rep", "n", "h"])
                common.release()

        made = self.texts(ids, n).mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "rep long, n long, h binary"]))
        return made.dropDuplicates(["rep", "n", *keep]) if repeated else made


def _dealt(h: np.ndarray, bits: int, x: np.ndarray, y: np.ndarray) -> dict[int, tuple[bytes, bytes]]:
    """Bytes of x and y by bucket, the first bits of the hash h."""
    if not len(h):
        return {}
    where = (h >> U(64 - bits)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    held, first = np.unique(where[order], return_index=True)
    return {int(b): (i.tobytes(), j.tobytes()) for b, i, j in zip(held, np.split(x[order], first[1:]), np.split(y[order], first[1:]), strict=True)}


def _sized(rows: DataFrame, chunk: int) -> DataFrame:
    """``rows`` (component, n, ...) with ``large``: whether the block is too large for one task."""
    sizes = rows.groupBy("component").agg(((F.count(F.lit(1)) > chunk) | (F.sum("n") * 8 > CHUNK_BYTES)).alias("large"))
    return common.checkpointed(rows.join(sizes, "component"))


def join(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, text: str = "text", key: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """(key, n_shingles, component_id) for each row of ``docs``: components of the links at similarity num/den and above."""
    t = Threshold(num, den)
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def describe(batches):
        for batch in batches:
            for rows, h, counts in _sets(batch, words):
                a, b = _set_keys(h, counts)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(t.step(np.maximum(counts, 1)).astype(np.int32)), pa.array(a), pa.array(b)], ["doc_id", "n", "step", "a", "b"])
            common.release()

    per_doc = common.checkpointed(docs.mapInArrow(describe, "doc_id long, n long, step int, a long, b long"))
    classes = common.checkpointed(per_doc.filter("n > 0 and doc_id is not null").groupBy("a", "b", "n", "step").agg(F.min("doc_id").alias("rep")))
    n_rows, n_classes = per_doc.count(), classes.count()
    repeated = not per_doc.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").isEmpty()
    job = Job(docs, words, t, n_classes)

    # Copies share their fingerprints, and of each batch only one row of a fingerprint goes on. Where most rows are copies, only
    # representatives are read; their texts are shuffled if there are many.
    given = docs.filter("doc_id is not null")
    if n_classes * 2 < n_rows:
        given = job.texts(classes.select(F.col("rep").alias("doc_id")).distinct(), n_classes)
    blocks = common.checkpointed(job.meeting(given, lambda h, counts: fingerprints(h, counts, t)))
    placed = lambda b: classes.join(b.withColumnRenamed("node", "a"), "a").select(F.col("rep").alias("doc_id"), "a", "b", "n", "step", "component")
    rows = _sized(placed(blocks), chunk)
    job.narrow(rows)
    big = rows.filter("large").select("doc_id")
    n_big = big.count()
    links = [_products(job, rows.filter("not large"), t, repeated)]
    if n_big:
        big = big.distinct()
        seen = job.sketch(job.texts(big, n_big))
        blocks = common.checkpointed(job.meeting(job.texts(big, n_big), lambda h, counts: prefixes(h, counts, t, seen.value)))
        rows = _sized(placed(blocks), chunk)
        links.append(_products(job, rows.filter("not large"), t, repeated))
        links += _large(job, rows.filter("large"), t, repeated, chunk, seen)
    # A doc_id that stands for several classes (repeated with other texts) links them as well.
    named = per_doc.filter("n > 0 and doc_id is not null").join(classes, ["a", "b", "n"]).select("doc_id", "rep").distinct() if repeated else None
    if named is not None:
        links.append(named.filter("doc_id <> rep").join(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "doc_id").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst")))
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    merged = common.components(every)
    classes = classes.join(merged, F.col("rep") == F.col("node"), "left").select("a", "b", "n", F.coalesce("component", "rep").alias("component_id"))
    return per_doc.join(classes, ["a", "b", "n"], "left").select(
        F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.least("doc_id", F.coalesce("component_id", "doc_id"))).alias("component_id")
    )


def _products(job: Job, rows: DataFrame, t: Threshold, repeated: bool) -> DataFrame:
    """Links (src, dst) of blocks that one task holds."""

    def within(table: pa.Table) -> pa.Table:
        src, dst = _forest(table, None, t)
        return pa.table({"src": src, "dst": dst})

    return common.checkpointed(job.incidence(rows, rows.count(), ["component"], repeated).groupBy("component").applyInArrow(within, "src long, dst long"))


def _large(job: Job, rows: DataFrame, t: Threshold, repeated: bool, chunk: int, seen) -> list[DataFrame]:
    """Links of blocks that are cut into chunks by size step and hash."""
    n_large = rows.count()
    if not n_large:
        return []
    held = rows.groupBy("component", "step").agg(F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("n") * 8 / CHUNK_BYTES)).cast("int").alias("chunks"))
    rows = common.checkpointed(rows.join(held, ["component", "step"]).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "a"), F.col("chunks")).cast("int")).select("doc_id", "a", "b", "n", "component", "step", "chunk"))
    chunks = common.checkpointed(held.select("component", "step", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")))
    words = job.words

    def score(batches):
        for batch in batches:
            for part, h, counts in _sets(batch, words):
                mean = np.bincount(np.repeat(np.arange(len(counts)), counts), seen.value[_slots(h)], len(counts)) / np.maximum(counts, 1)
                yield pa.RecordBatch.from_arrays([part.column("component"), part.column("doc_id"), part.column("a"), part.column("b"), pa.array(counts, pa.int64()), pa.array(mean)], ["component", "doc_id", "a", "b", "n", "score"])
            common.release()

    scored = job.texts(rows.select("doc_id", "a", "b", "component"), n_large).mapInArrow(score, "component long, doc_id long, a long, b long, n long, score double")
    scored = common.checkpointed(scored)
    most = scored.groupBy("component").agg(F.least(F.lit(LEADERS), F.greatest(F.lit(2), F.floor(LEADER_SHINGLES / F.avg("n")))).alias("most"))
    of = Window.partitionBy("component")
    by_score, by_hash = (
        scored.withColumn("k", F.row_number().over(of.orderBy(*order))).filter(F.col("k") <= n).select("component", "doc_id", "a", "b", (F.col("k") * (LEADERS // n)).alias("k"))
        for order, n in (([F.desc("score"), "doc_id", "a"], LEADERS // 2), ([F.xxhash64("doc_id", "a"), "doc_id"], LEADERS // 4))
    )
    leaders = by_score.unionByName(by_hash).join(most, "component").filter((F.col("k") <= F.col("most")) | (F.col("k") <= 4)).select("component", "doc_id", "a", "b").distinct()
    leaders = common.checkpointed(leaders)
    matrix = job.incidence(rows, n_large, ["component", "step", "chunk"], repeated)
    first = matrix.unionByName(job.incidence(leaders, leaders.count(), ["component"], repeated).join(chunks, "component"))

    def within(table: pa.Table) -> pa.Table:
        src, dst = _forest(table, None, t)
        return pa.table({"src": src, "dst": dst})

    links = common.checkpointed(first.groupBy("component", "step", "chunk").applyInArrow(within, "src long, dst long"))
    # Rows of a block's largest component need no more links among each other.
    found = common.components(links)
    rooted = common.checkpointed(rows.join(found.select(F.col("node").alias("doc_id"), F.col("component").alias("root")), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")))
    largest = rooted.groupBy("component", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("component").agg(F.max(F.struct("k", "root"))["root"].alias("done"))
    lone = rooted.join(largest, "component").filter("root <> done")
    parts = lone.groupBy("component", "step").agg(F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("n") * 8 / CHUNK_BYTES)).cast("int").alias("parts"))
    lone = common.checkpointed(lone.join(parts, ["component", "step"]).select("doc_id", "a", "b", "component", "step", F.pmod(F.xxhash64("doc_id", "a"), F.col("parts")).cast("int").alias("part"), "parts"))
    n_lone = lone.count()
    if not n_lone:
        return [links]
    # A part of lone rows meets the chunks of its own size step and of those beside it.
    meets = lone.select("component", F.col("step").alias("of"), "part").distinct().join(chunks, "component").filter(F.abs(F.col("of") - F.col("step")) <= 1)
    meets = common.checkpointed(meets.select("component", "of", "part", "step", "chunk"))
    one = job.incidence(lone.withColumnRenamed("step", "of"), n_lone, ["component", "of", "part"], repeated).join(meets, ["component", "of", "part"]).withColumn("alone", F.lit(True))
    two = matrix.join(meets, ["component", "step", "chunk"]).withColumn("alone", F.lit(False))

    def across(table: pa.Table) -> pa.Table:
        src, dst = _forest(table, np.flatnonzero(table.column("alone").to_numpy()), t)
        return pa.table({"src": src, "dst": dst})

    more = one.unionByName(two).groupBy("component", "of", "part", "step", "chunk").applyInArrow(across, "src long, dst long")
    return [links, common.checkpointed(more)]


def keep_one(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with one row of each group of linked documents, the one with the smallest doc_id; all columns.

    Rows without words and rows with a null doc_id stay. Rows that repeat a doc_id count as copies of one document.
    """
    found = common.checkpointed(join(docs, words, num, den))
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    gone = F.broadcast(gone) if found.filter("doc_id <> component_id").count() <= SEND_IDS else shuffled(gone)
    left = docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    again = common.checkpointed(found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if again.isEmpty():
        return left
    return left.join(again, "doc_id", "left_anti").unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*[F.col(f"`{c}`") for c in docs.columns])
