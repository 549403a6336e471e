"""Sharding in the order of a Hilbert curve over several metadata dimensions, with DataFrame functions only.

Each dimension is quantised to ``bits`` bits, in the order of its values: a text column into ranges of about equal row counts, by
the first two bytes after the prefix that all values share (null is a range of its own); a size by its
logarithm in half steps. The cell's index on the curve is looked up level by level in a table of the curve's states, which
is made from the rule of the compact construction (Gray code, entry point and direction of each subcube). Rows are ranked by (curve
index, hash of the key) and the order is cut into runs of equal row counts, so each shard covers a compact part of the
metadata space and a reader can skip shards by the least and greatest values of their columns (``zones``).

Law ``rows``: shard counts are at most one apart. Null in a dimension or in the text is a value like others; empty
tables give no rows; equal rows get places of their own.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.ranks import ranked

BITS = 5


@cache
def curve_states(dims: int) -> tuple[list[int], list[int]]:
    """(digit, next state) at state * 2**dims + cell. A state is the entry corner and the direction of a subcube."""
    n, side = dims, 1 << dims

    def turn(x: int, k: int) -> int:
        k %= n
        return (x >> k | x << n - k) & side - 1

    def gray(i: int) -> int:
        return i ^ i >> 1

    rank = {gray(i): i for i in range(side)}
    entry = lambda i: 0 if i == 0 else gray(2 * ((i - 1) // 2))
    ones = lambda i: ((i ^ i + 1) >> 1).bit_length()  # noqa: E731  trailing ones

    def direction(i: int) -> int:
        return 0 if i == 0 else (ones(i - 1) if i % 2 == 0 else ones(i)) % n

    states, digits, following = {(0, 0): 0}, [], []
    todo = [(0, 0)]
    while todo:
        e, d = todo.pop(0)
        for cell in range(side):
            w = rank[turn(cell ^ e, d + 1)]
            then = (e ^ turn(entry(w), -(d + 1)), (d + direction(w) + 1) % n)
            if then not in states:
                states[then] = len(states)
                todo.append(then)
            digits.append(w)
            following.append(states[then])
    return digits, following


def curve_index(cells: list[Column], bits: int = BITS) -> Column:
    """The place on the curve of quantised dimensions, each from 0 to 2**bits - 1."""
    digits, following = curve_states(len(cells))
    side = 1 << len(cells)
    corner = lambda b: sum((c.bitwiseAND(F.shiftleft(F.lit(1), b)) != 0).cast("int") * (1 << k) for k, c in enumerate(cells))
    levels = F.array(*[corner(b) for b in range(bits - 1, -1, -1)])
    table = lambda xs: F.array(*map(F.lit, xs))
    step = lambda a, o: F.struct((a["h"] * side + F.element_at(table(digits), a["s"] * side + o + 1)).cast("long").alias("h"), F.element_at(table(following), a["s"] * side + o + 1).alias("s"))
    return F.aggregate(levels, F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s")), step, lambda a: a["h"])


def ranges(docs: DataFrame, columns: tuple[str, ...], bits: int = BITS) -> list[tuple[int, list[int]]]:
    """For each text column: the length of the prefix in bytes, and where its ranges of about equal row counts begin, as two bytes."""
    ends = docs.agg(*[f(F.encode(F.col(f"`{c}`"), "utf-8")).alias(f"{n}{k}") for k, c in enumerate(columns) for f, n in ((F.min, "a"), (F.max, "z"))]).first()
    prefix = []
    for k in range(len(columns)):
        a, z = bytes(ends[f"a{k}"] or b""), bytes(ends[f"z{k}"] or b"")
        prefix.append(next((i for i, (x, y) in enumerate(zip(a, z)) if x != y), min(len(a), len(z))))
    places = F.array(*[F.struct(F.lit(k).alias("k"), _bytes(F.col(f"`{c}`"), n).alias("b")) for k, (c, n) in enumerate(zip(columns, prefix, strict=True))])
    counts = docs.select(F.explode(places).alias("x")).filter("x.b is not null").groupBy("x.k", "x.b").agg(F.count(F.lit(1)).alias("n"))
    held: list[dict[int, int]] = [{} for _ in columns]
    for r in counts.collect():  # at most 65,536 rows a column
        held[r["k"]][r["b"]] = r["n"]
    out, parts = [], (1 << bits) - 1
    for n, own in zip(prefix, held, strict=True):
        total, before, cuts = sum(own.values()), 0, []
        for b in sorted(own):
            cuts += [b] * (before * parts // total - len(cuts))
            before += own[b]
        out.append((n, cuts))
    return out


def _bytes(c: Column, prefix: int) -> Column:
    return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), prefix + 1, 2)), 4, "0"), 16, 10).cast("int")


def of_text(c: Column, prefix: int, cuts: list[int]) -> Column:
    # The bytes are a lambda's argument, so that they are computed once a row.
    below = F.element_at(F.transform(F.array(_bytes(c, prefix)), lambda b: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= b))), 1) if cuts else F.lit(0)
    return F.when(c.isNull(), 0).otherwise(1 + below).cast("int")


def of_size(c: Column, bits: int = BITS) -> Column:
    return F.least(F.floor(2 * F.log2(c.cast("double") + 1)), F.lit((1 << bits) - 1)).cast("int")


def shards(docs: DataFrame, n: int = 8, bits: int = BITS, key: str = "doc_id", text: str = "text", by: tuple[str, ...] = ("source", "lang"), keep: list[str] | None = None) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard, cell) for each row, and the columns ``keep``."""
    names = [f"k{i}" for i in range(len(keep or []))]
    body = F.col(f"`{text}`")
    size = F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 1
    cells = [*[of_text(F.col(f"`{c}`"), *r) for c, r in zip(by, ranges(docs, by, bits), strict=True)], of_size(size, bits)]
    rows = docs.select(
        F.col(f"`{key}`").alias("key"), size.alias("size"), F.crc32(body).alias("crc"), curve_index(cells, bits).alias("cell"), F.xxhash64(F.lit(17), F.col(f"`{key}`"), body).alias("h"), *[F.col(f"`{c}`").alias(i) for c, i in zip(keep or [], names, strict=True)]
    )
    # Cells before a cell: rows of the earlier cells under its upper half, and of the earlier upper halves. Both tables are bounded by the number of cells.
    half = len(cells) * bits // 2
    held = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("upper", F.shiftright("cell", half))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    tops = held.groupBy("upper").agg(F.sum("n").alias("n"))
    tops = tops.select(F.col("upper").alias("u"), F.coalesce(F.sum("n").over(upto(Window.orderBy("upper"))), zero).alias("above"), F.sum("n").over(Window.partitionBy()).alias("total"))
    held = held.join(F.broadcast(tops), F.col("upper") == F.col("u"))  # at most 2 ** (dims * bits / 2) rows
    held = held.select(F.col("cell").alias("c"), (F.col("above") + F.coalesce(F.sum("n").over(upto(Window.partitionBy("upper").orderBy("cell"))), zero)).alias("before"), "total")
    done = ranked(rows, ["cell"], ["h", "key"], "r", salts=256).join(held, F.col("cell") == F.col("c"))
    place = F.col("before") + F.col("r")
    # Shard s holds the places from ceil(s * total / n).
    done = done.withColumn("shard", F.expr(f"({n} * (before + r)) div total"))
    start = F.expr(f"(shard * total + {n} - 1) div {n}")
    return done.select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (place - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "cell", *[F.col(i).alias(c) for c, i in zip(keep or [], names, strict=True)]
    )


def zones(sharded: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(shard, rows, least and greatest value of each column): what a reader needs to skip shards. One row a shard."""
    ends = [f(F.col(f"`{c}`")).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "min"), (F.max, "max"))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *ends)
