"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code point order (null last) weigh 5, 2, 1, repeating. ``share`` of all words is dealt to them by weight; what is above
``most`` times a source's own words is dealt again, by weight, until no source is above. A source's target is met with whole
documents: each is taken as often as its target holds the whole source (0, 1 or 2 times), and the remaining budget is fitted
over the counts of documents by exact length: first the same fraction of each length, then the longest lengths that fit,
and when the rest is at most ``exact`` words, a bounded-knapsack dynamic programme finds the lengths whose sum is
nearest to it from below. Where that misses the budget, the programme is run again over all of it, with no documents taken before,
and the nearer sum is used. That one is exact while its bits (budget times splits of the counts) fit ``BITS``; beyond that most
of the budget is dealt by the same fraction first, and if documents are longer than the programme, sums are kept in
cells: exact while there are few, else off by at most a cell for each split. Which documents of a length are taken is decided by a seeded hash, so reruns agree.

Only (source, length, count) rows go to the fitting, one task a source. A null text has size 0. Documents of size 0 take nothing.
A source with no words has the target 0. Equal rows are separate documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common
from lodestone.llm.ranks import ranked

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
EXACT = 1 << 15
#: Bits of the programme over a whole budget (128 MB), and sums it holds in all where they are kept one by one.
BITS = 1 << 30
SUMS = 1 << 23
SEED = 20_240_601
MOST_SOURCES = 100_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Target of each source. ``sizes``: (source, words)."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    w = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    size, out, open_ = dict(sizes), {}, [s for s, _ in order]
    left = share * sum(size.values())
    while open_:
        unit = left / sum(w[s] for s in open_)
        above = [s for s in open_ if unit * w[s] > most * size[s]]
        if not above:
            return out | {s: unit * w[s] for s in open_}
        for s in above:
            out[s] = most * size[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def fit(lengths: list[int], counts: list[int], budget: int, exact: int = EXACT, bits: int = BITS, sums: int = SUMS) -> list[int]:
    """How many documents of each length to take for a sum near ``budget``, never above it."""
    budget = min(budget, sum(n * c for n, c in zip(lengths, counts, strict=True)))
    first = _short_rest(lengths, counts, budget, exact)
    best = sum(n * t for n, t in zip(lengths, first, strict=True))
    if best == budget:
        return first
    second = _whole_budget(lengths, counts, budget, bits, sums)
    return second if sum(n * t for n, t in zip(lengths, second, strict=True)) > best else first


def _splits(lengths: list[int], spare: list[int], left: int) -> list[tuple[int, int]]:
    """(length's index, documents) whose subsets are all the numbers that fit, the longest lengths first."""
    out = []
    for i in sorted((i for i, n in enumerate(lengths) if 0 < n <= left), key=lambda i: -lengths[i]):
        more, part = min(spare[i], left // lengths[i]), 1
        while more > 0:
            use = min(part, more)
            out.append((i, use))
            more -= use
            part *= 2
    return out


def _whole_budget(lengths: list[int], counts: list[int], budget: int, bits: int, sums: int) -> list[int]:
    """The programme over the whole budget, or over as much of it as ``bits`` allows."""
    take, left = [0] * len(lengths), budget
    width = bits // max(1, len(_splits(lengths, counts, left)))
    if left > width:
        total = sum(n * c for n, c in zip(lengths, counts, strict=True))
        take = [c * (budget - width // 2) // total if n else 0 for n, c in zip(lengths, counts, strict=True)]
        left -= sum(n * t for n, t in zip(lengths, take, strict=True))
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            more = min(counts[i] - take[i], (left - width // 2) // lengths[i]) if lengths[i] and left > width else 0
            take[i] += max(0, more)
            left -= max(0, more) * lengths[i]
    if left > width:  # documents longer than the programme
        take, left = [0] * len(lengths), budget
    steps = _splits(lengths, [c - t for c, t in zip(counts, take, strict=True)], left)
    if left <= width:
        full, rows = (1 << left + 1) - 1, [1]
        for i, use in steps:
            rows.append(rows[-1] | rows[-1] << use * lengths[i] & full)
            if rows[-1] >> left & 1:
                break
        s, held = rows[-1].bit_length() - 1, lambda k, s: rows[k] >> s & 1
        last = len(rows) - 1
    else:
        cells = max(1024, sums // max(1, len(steps)))
        kept = [np.zeros(1, np.int64)]
        for i, use in steps:
            both = np.union1d(kept[-1], kept[-1] + use * lengths[i])
            both = both[both <= left]
            if len(both) > cells:
                cell = both // -(-(left + 1) // cells)
                both = both[np.append(cell[1:] != cell[:-1], True)]  # the highest sum of each cell
            kept.append(both)
            if both[-1] == left:
                break
        s, last = int(kept[-1][-1]), len(kept) - 1

        def held(k: int, s: int) -> bool:
            at = int(np.searchsorted(kept[k], s))
            return at < len(kept[k]) and int(kept[k][at]) == s

    for k in range(last, 0, -1):
        if not held(k - 1, s):
            i, use = steps[k - 1]
            take[i] += use
            s -= use * lengths[i]
    return take


def _short_rest(lengths: list[int], counts: list[int], budget: int, exact: int) -> list[int]:
    """The same fraction of each length, and the programme over at most ``exact`` words that are left."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    take = [c * budget // total if total else 0 for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = sorted((i for i, n in enumerate(lengths) if n > 0), key=lambda i: -lengths[i])
    for i in order:
        if left <= exact:
            break
        more = min(counts[i] - take[i], (left - exact // 2) // lengths[i])
        if more > 0:
            take[i] += more
            left -= more * lengths[i]
    for i in reversed(order):  # a few short documents go back, so that the programme has a choice
        more = min(take[i], 2)
        if left + more * lengths[i] > exact // 4:
            break
        take[i] -= more
        left += more * lengths[i]
    # Bounded knapsack: bit s of a row is set if the sum s can be reached with the lengths up to it.
    left = max(0, left)
    full, rows = (1 << min(left, exact) + 1) - 1, [1]
    steps = []
    for i in order:
        n, spare, part = lengths[i], counts[i] - take[i], 1
        while spare > 0 and part * n <= left:
            use = min(part, spare)
            rows.append(rows[-1] | rows[-1] << use * n & full)
            steps.append((i, use))
            spare -= use
            part *= 2
        if rows[-1] >> min(left, exact) & 1:
            break
    s = rows[-1].bit_length() - 1
    for k in range(len(steps), 0, -1):
        if not rows[k - 1] >> s & 1:
            i, use = steps[k - 1]
            take[i] += use
            s -= use * lengths[i]
    return take


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, key: str = "doc_id", source: str = "source", text: str = "text", extra: list[str] | None = None) -> DataFrame:
    """(key, size, source_size, target, copies, taken) for each row, and the columns ``extra``."""
    names = [f"x{k}" for k in range(len(extra or []))]
    size = F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")
    kinds = dict(docs.dtypes)
    told = [F.col(f"`{c}`") for c in extra or [] if "map<" not in kinds[c] and "variant" not in kinds[c]]  # rows equal in all of it are one and the same
    rows = docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("h"), F.xxhash64(F.lit(seed), *told).alias("tie"), *[F.col(f"`{c}`").alias(n) for c, n in zip(extra or [], names, strict=True)]
    )
    counts = common.checkpointed(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    per_source = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(per_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them first")
    goal = targets([(r["source"], r["size"]) for r in per_source], weights, share, most)
    whole = {r["source"]: r["size"] for r in per_source}

    def plan(key, table: pd.DataFrame) -> pd.DataFrame:
        source = None if pd.isna(key[0]) else key[0]
        base, rest = (0, 0) if not whole[source] else divmod(int(round(goal[source])), whole[source])
        table = table.sort_values("size").reset_index(drop=True)
        take = fit(table["size"].astype(int).tolist(), table["n"].astype(int).tolist(), rest) if base < most else [0] * len(table)
        return pd.DataFrame({"p_source": source, "p_size": table["size"], "base": base, "take": take, "source_size": whole[source], "target": float(goal[source])})

    plans = counts.groupBy("source").applyInPandas(plan, "p_source string, p_size long, base long, take long, source_size long, target double")
    done = ranked(rows, ["source", "size"], ["h", "tie", "key"], "r")
    done = done.join(plans, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
    copies = F.when(F.col("size") > 0, F.col("base") + (F.col("r") < F.col("take")).cast("long")).otherwise(0)
    return done.select(F.col("key").alias(key), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *[F.col(n).alias(c) for c, n in zip(extra or [], names, strict=True)])


def apply(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, all columns."""
    key, source, text = (options.get(k, v) for k, v in (("key", "doc_id"), ("source", "source"), ("text", "text")))
    held = mix(common.whole(docs, key, source, text), extra=["row"], **options)
    copies = held.filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return copies.select("row.*")
