"""Spelling variants: words one edit apart, found with Aho-Corasick automata over the halves of words.

One inserted, deleted or replaced letter falls into one of a word's two halves and leaves the other as it is: the first half
at the start of the near word, or the second at its end. An automaton over halves, scanned with a word, finds the halves that occur in it; a hit
counts if its offset is right (start or end), the lengths differ by one at most and the distance is one.

The halves are dealt to shards by their hash. A word goes to the shards that may hold a half of it (a word of n letters
starts with a half of one of n - 1, n or n + 1), and each shard scans it once. A half that more than ``COMMON`` words
have is cut: instead of it stand the two parts that keep the half and, of the rest, again one half (a start and an end, one of
which may be empty), and so on down to a single letter, of which an alphabet bounds the number. Within a shard the same is done from ``CROWD`` words
on. So no pair is lost, and no common half meets in one task or costs the square of its words.

A pair is reported once, by the part in which the first letter lies that differs. Words are compared by code points.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

#: Letters of a run, and those of at least so many.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
LEAST = 7
#: Entries of a shard; entries of one half above which it is cut before it is dealt, and within a shard.
SHARD, COMMON, CROWD = 60_000, 20_000, 8
FOUND = "word string, near long, most long, form string"


def one_edit(x: str, y: str) -> int:
    """Where the only difference of two parts begins that differ in length by one at most, -1 if there are more."""
    n, m, p = len(x), len(y), 0
    for a, b in zip(x, y):  # noqa: B905
        if a != b:
            break
        p += 1
    return p if x[p + (n >= m) :] == y[p + (m >= n) :] else -1


def halves(n: int) -> list[tuple[int, int]]:
    """The parts [s, e) of a word of n letters in which the edit may lie: what is before and after stays."""
    return [(0, n // 2), (n // 2, n)]


class Shard:
    """Automaton over the kept starts and ends of a shard's entries, with what else must fit."""

    def __init__(self, entries: list[tuple[str, int, int, int]], crowd: int = CROWD) -> None:
        """``entries``: (word, its count, s, e)."""
        import ahocorasick

        groups: dict[tuple[int, int, int, str, str], list[tuple[str, int]]] = {}
        for word, n, s, e in entries:
            groups.setdefault((len(word), s, e, word[:s], word[e:]), []).append((word, n))
        todo, held = list(groups.items()), {}
        while todo:
            (length, s, e, start, end), own = todo.pop()
            if len(own) <= crowd or e - s < 2:
                held[length, s, e, start, end] = own
                continue
            mid, parts = (s + e) // 2, {}
            for word, n in own:
                for a, b in ((s, mid), (mid, e)):
                    parts.setdefault((length, a, b, word[:a], word[b:]), []).append((word, n))
            todo += parts.items()
        #: The longer of start and end is what the automaton looks for; for each shape of a part, the other leads to the words.
        kept: dict[str, dict[tuple[bool, int, int, int], dict[str, list]]] = {}
        for (length, s, e, start, end), own in held.items():
            by_start = s >= length - e
            kept.setdefault(start if by_start else end, {}).setdefault((by_start, length, s, e), {})[end if by_start else start] = own
        self.auto = ahocorasick.Automaton()
        for segment, shapes in kept.items():
            self.auto.add_word(segment, (len(segment), list(shapes.items())))
        if kept:
            self.auto.make_automaton()

    def near(self, word: str) -> list[tuple[str, int]]:
        """(entry, its count) of all that are one edit from the word."""
        out, m = [], len(word)
        for last, (size, shapes) in self.auto.iter(word):
            at_start, at_end = last + 1 == size, last + 1 == m
            if not (at_start or at_end):
                continue
            for (by_start, length, s, e), others in shapes:
                if not (at_start if by_start else at_end) or not -2 < length - m < 2 or m < s + length - e:
                    continue
                own = others.get(word[m - length + e :] if by_start else word[:s])
                if own is None:
                    continue
                rest = word[s : m - (length - e)]
                for entry, n in own:
                    if (p := one_edit(entry[s:e], rest)) >= 0 and entry != word:
                        p, top = p + s, min(length, m)
                        while p < top and entry[p] == word[p]:  # a letter left out among equal ones may seem to be missing in either part
                            p += 1
                        if min(p, length - 1) < e:
                            out.append((entry, n))
        return out


def scanned(table: pa.Table) -> pa.Table:
    """One shard: for each word scanned its near words, the largest count among them and the first word that has it."""
    asks = pc.is_null(table.column("s"))
    own = table.filter(pc.invert(asks))
    shard = Shard(list(zip(*(own.column(c).to_pylist() for c in ("word", "n", "s", "e")), strict=True)))
    out = []
    for word in sorted(set(table.filter(asks).column("word").to_pylist())):
        if found := shard.near(word):
            n, form = min((-n, entry) for entry, n in found)
            out.append((word, len(found), -n, form))
    return pa.table({c: pa.array([r[k] for r in out], kind) for k, (c, kind) in enumerate((("word", pa.string()), ("near", pa.int64()), ("most", pa.int64()), ("form", pa.string())))})


def word_counts(docs: DataFrame, least: int = LEAST, twice: int = 2) -> DataFrame:
    """(word, n): the words of all texts, damaged as the query of this operator asks: where 31 divides the crc32 of ``doc_id:run``, a letter is taken out."""
    low = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(low, F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat_ws(":", "doc", "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % 31 == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    words = runs.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= twice)


def parts_of(rows: DataFrame, pairs: Column) -> DataFrame:
    """A row for each part (s, e) of ``pairs``, with the hash of what stays of a word of ``size`` letters."""
    out = rows.withColumn("p", F.explode(pairs)).withColumns({"s": F.col("p.s"), "e": F.col("p.e")}).drop("p")
    own = F.length("word")
    start, end = F.substring(F.col("word"), F.lit(1), F.col("s")), F.substring(F.col("word"), own - (F.col("size") - F.col("e")) + 1, F.col("size") - F.col("e"))
    return out.filter(own >= F.col("s") + F.col("size") - F.col("e")).withColumn("key", F.xxhash64(start, end))


def part(s, e) -> Column:
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))


def near_words(words: DataFrame, least: int = LEAST, shard: int = SHARD, common_above: int = COMMON) -> DataFrame:
    """(word, n, near, most, form) for (word, n): the number of near words, and the one of the largest n (ties: the smallest), null if there are none."""
    size = F.col("size")
    both = F.array(part(F.lit(0), F.floor(size / 2)), part(F.floor(size / 2), size))
    entries = parts_of(words.withColumn("size", F.length("word")), both)
    asks = parts_of(words.select("word", F.explode(F.filter(F.array(*[F.length("word") + k for k in (-1, 0, 1)]), lambda x: x >= least)).alias("size")), both)
    # Halves that very many words have are cut. They are few: each has more than ``common_above`` entries.
    while hot := [r["key"] for r in entries.filter("e - s > 1").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > common_above).select("key").collect()]:
        cut = F.broadcast(words.sparkSession.createDataFrame([(k,) for k in hot], "key long").withColumn("hot", F.lit(True)))
        mid = F.floor((F.col("s") + F.col("e")) / 2)
        own = part(F.col("s"), F.col("e"))
        pairs = F.when(F.col("hot") & (F.col("e") - F.col("s") > 1), F.array(part(F.col("s"), mid), part(mid, F.col("e")))).otherwise(F.array(own))
        entries, asks = (common.checkpointed(parts_of(x.join(cut, "key", "left").withColumn("pairs", pairs).drop("key", "s", "e", "hot"), F.col("pairs")).drop("pairs")) for x in (entries, asks))
    shards = max(1, -(-2 * words.count() // shard))
    number = F.pmod("key", F.lit(shards)).cast("int").alias("shard")
    none = F.lit(None).cast("int")
    given = entries.select(number, "word", "n", "s", "e").unionByName(asks.select(number, "word", F.lit(None).cast("long").alias("n"), none.alias("s"), none.alias("e")).distinct())
    found = given.repartition(shards, "shard").groupBy("shard").applyInArrow(scanned, FOUND)
    all_words = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("most"), F.lit(None).cast("string").alias("form"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("most")).alias("most"), "form")))
    out = all_words.unionByName(found.select("word", F.lit(None).cast("long").alias("n"), "near", "most", "form")).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("near"), best.alias("best"))
    return out.select("word", "n", "near", (-F.col("best.most")).alias("most"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form), no form null: each word leads to its form's form and so on; the way is halved in each round.

    A form has ten times its word's count, so ways are short and end.
    """
    ways = common.checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ways.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        ways = common.checkpointed(ways.join(further, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
        if not ways.filter("moved").limit(1).count():
            return ways.select("word", "root")
        ways = ways.drop("moved")


def group(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for (word, n), each word once.

    A word's form is its near word of the largest count if that is ``times`` its own; its root is where forms lead. A table without words gives no rows.
    """
    words = common.checkpointed(words.select("word", "n"))
    good = F.col("most") >= times * F.col("n")
    told = common.checkpointed(near_words(words).select("word", "n", F.col("near").alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("most")).alias("form_n")))
    ways = roots(told.filter("form is not null"))
    return told.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
