"""Conversation structure repair: the cheapest edits that make the roles of a conversation fit ``(s?(ua)+)?``.

The rows of a conversation are read against a four-state automaton of that pattern: keep a row, give it another role, delete
it, or insert an empty row. The automaton with these costs is determinised as it is used: the costs from each of its states
to a good end, less their least, are one state of the new automaton, and each (state, kind of row) is worked out once and
kept in a table. A scan from the last row to the first is so a lookup a row. The way back, from the first row to the
last, follows tight arcs, those whose cost is the difference between two vectors, and of these the one whose letter is least: it
gives the edits, ties resolved to the least string in ASCII order (D, I, K, R).

Rows are sorted into ranges of (conversation, turn), so that a conversation of any size is spread over tasks. Only for the first and last conversation of
a range that go on beyond it, the ranges exchange 4 by 4 costs (from which state to which) and then the state in which each
range begins; that is two rows a range, on the driver.

A row's fault is the first of: ``blank`` (nothing but ASCII white space), ``duplicate`` (an earlier row has its role and
text) and ``truncated`` (the last letter that isn't white space is none of ``.!?``). Blank and duplicate rows must go,
truncated ones cost more if they stay. Null roles and texts count as one space; null turns come first; rows of one turn are ordered by role, then by
text; rows equal in all of these stand side by side. Null is a conversation of its own. No rows give no rows.
Other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common

#: States of the pattern: at the start, after s, after u, after a. What each reads (s, u, a) and what it may be given (u or a).
READS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GIVEN = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
ENDS = (0, 3)
#: Kinds of rows: those that must go, then each role initial with and without a truncated text.
GONE, INITIALS = 0, "sua?"


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Table:
    """The determinised automaton, built as it is asked for. A state is a vector of costs to a good end, its least 0."""

    def __init__(self, costs: Costs) -> None:
        self.costs, self.vectors, self.numbers = costs, [], {}
        self.steps: dict[tuple[int, int], tuple[int, float]] = {}
        self.arcs: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end = self.number(self.closed([0 if q in ENDS else math.inf for q in range(4)]))[0]

    def number(self, v: list) -> tuple[int, float]:
        """(state, what was taken off its vector)."""
        low = min(v)
        key = tuple(x - low for x in v)
        if key not in self.numbers:
            self.numbers[key] = len(self.vectors)
            self.vectors.append(key)
        return self.numbers[key], low

    def closed(self, v: list) -> list:
        """Rows may be inserted before what comes."""
        v = list(v)
        for _ in range(3):
            for q, (_, to) in enumerate(GIVEN):
                v[q] = min(v[q], v[to] + self.costs.insert)
        return v

    def edits(self, kind: int, q: int) -> list[tuple[str, int, int]]:
        """(letter, cost, next state) of what may be done with a row, least letter first."""
        out = [("D", self.costs.delete, q)]
        if kind != GONE:
            initial, more = INITIALS[(kind - 1) // 2], self.costs.truncated * ((kind - 1) % 2)
            if initial in READS[q]:
                out.append(("K", more, READS[q][initial]))
            out.append(("R", self.costs.rerole + more, GIVEN[q][1]))
        return out

    def raw(self, after: int, kind: int) -> list:
        v = self.vectors[after]
        return self.closed([min(c + v[to] for _, c, to in self.edits(kind, q)) for q in range(4)])

    def step(self, after: int, kind: int) -> tuple[int, float]:
        """The state before a row from that after it, and the cost taken off."""
        found = self.steps.get((after, kind))
        if found is None:
            found = self.steps[after, kind] = self.number(self.raw(after, kind))
        return found

    def arc(self, after: int, kind: int, q: int) -> tuple[str, int]:
        """The least tight arc from q before a row: (letter, next state); I stays before the row."""
        found = self.arcs.get((after, kind, q))
        if found is None:
            v, own, to = self.vectors[after], self.raw(after, kind), GIVEN[q][1]
            tight = [(e, t) for e, c, t in self.edits(kind, q) if c + v[t] == own[q]]
            found = self.arcs[after, kind, q] = min(tight + [("I", to)] * (own[to] + self.costs.insert == own[q]))
        return found

    def scan(self, kinds: bytes, after: int) -> tuple[list[int], float]:
        """The state after each row, and before the first as the last entry; rows are read backwards. And the cost in all."""
        states, total = [after], 0.0
        for kind in reversed(kinds):
            after, low = self.step(after, kind)
            states.append(after)
            total += low
        return states, total

    def costs_between(self, kinds: bytes) -> list[list[float]]:
        """Least cost from each state before the rows to each state after them."""
        out = []
        for end in range(4):
            states, total = self.scan(kinds, self.number([0 if q == end else math.inf for q in range(4)])[0])
            out.append([x + total for x in self.vectors[states[-1]]])
        return [[out[e][q] for e in range(4)] for q in range(4)]

    def trace(self, kinds: bytes, after: int, q: int, last: bool) -> tuple[list[tuple[str, int, int]], int]:
        """Edits (letter, row or -1, state before it) from state q on, and the state at the end; ``last``: the conversation ends there."""
        states, _ = self.scan(kinds, after)
        out = []
        for i, kind in enumerate(kinds):
            letter = "I"
            while letter == "I":
                letter, to = self.arc(states[len(kinds) - 1 - i], kind, q)
                out.append((letter, -1 if letter == "I" else i, q))
                q = to
        while last and q not in ENDS:
            out.append(("I", -1, q))
            q = GIVEN[q][1]
        return out, q


def rows_in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault, kind) sorted over ranges: equal rows are counted before they move, and found again as duplicates."""
    given = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    told = given.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("digest", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    # A second key, so that both sides of the join below are plain shuffles, whose large parts are split.
    seen = told.groupBy("conv_id", "digest", F.crc32("digest").alias("z")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first"), F.count(F.lit(1)).alias("turns")).filter("turns > 1")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.col("first.turn").alias("first_turn"), F.lit(True).alias("often"))
    told = told.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    earlier = F.coalesce("often", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    told = told.select("conv_id", "turn", "role", "text", earlier.alias("earlier"), last.alias("last"), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    fault = F.when(F.col("last") == "", "blank").when(F.col("earlier") | (F.col("copy") > 1), "duplicate").when(~F.col("last").isin(*".!?"), "truncated")
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    told = told.withColumn("fault", fault).withColumn("kind", F.when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(1 + 2 * place + F.when(F.col("fault") == "truncated", 1).otherwise(0)).cast("tinyint"))
    by = ["conv_id", "turn", "role", "text", "copy"]
    return told.drop("earlier", "last").repartitionByRange(*by).sortWithinPartitions(*by).drop("copy")


def pieces(batches) -> tuple[list[tuple[object, int, int]], bytes, pa.Table]:
    """The runs (conversation, first, end) of a range, the kinds of its rows, and the rows."""
    batches = list(batches)
    table = pa.Table.from_batches(batches) if batches else None
    out: list[tuple[object, int, int]] = []
    if table is None or not table.num_rows:
        return out, b"", table
    table = table.combine_chunks()
    runs = pc.run_end_encode(table.column("conv_id").combine_chunks())
    start = 0
    for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
        if out and out[-1][0] == value and (out[-1][0] is None) == (value is None):
            out[-1] = (value, out[-1][1], end)
        else:
            out.append((value, start, end))
        start = end
    return out, table.column("kind").to_numpy().astype("uint8").tobytes(), table


def repair(rows: DataFrame, costs: Costs | None = None) -> DataFrame:
    """(conv_id, part, at, turn, fault, given_role, edit, role, text): every row with what becomes of it, and the rows inserted (turn and given_role null).

    A conversation's rows are in the order of (part, at); those that stay have an edit K, R or I, and role and text as repaired.
    """
    costs = costs or Costs()
    held = common.checkpointed(rows_in_order(rows)).withColumn("part", F.spark_partition_id())
    conv, turn = held.schema["conv_id"].dataType, held.schema["turn"].dataType

    # ---- conversations that go over the edge of a range: from which state to which, at what cost
    slim = held.select("conv_id", "part", "kind")
    edge = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("conv_id", conv), T.StructField("first", T.BooleanType()), T.StructField("last", T.BooleanType()), T.StructField("costs", T.ArrayType(T.DoubleType()))])

    def edges(batches):
        runs, kinds, table = pieces(batches)
        part = table.column("part")[0].as_py() if runs else None
        own = [{"part": part, "conv_id": c, "first": s == 0, "last": e == len(kinds), "costs": [x for r in Table(costs).costs_between(kinds[s:e]) for x in r]} for c, s, e in runs if s == 0 or e == len(kinds)]
        if own:
            yield pa.RecordBatch.from_pylist(own, table_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    table_schema = to_arrow_schema(edge)
    found = sorted((r.asDict() for r in slim.mapInArrow(edges, edge).collect()), key=lambda r: (r["part"], not r["first"]))  # two rows a range at most
    chains: list[list[dict]] = []
    for r in found:
        joins = bool(chains) and r["first"] and chains[-1][-1]["last"] and chains[-1][-1]["conv_id"] == r["conv_id"] and chains[-1][-1]["part"] != r["part"]
        chains[-1].append(r) if joins else chains.append([r])
    chains = [c for c in chains if len(c) > 1]
    table = Table(costs)
    ends: dict[tuple[int, bool], list[float]] = {}  # (range, whether its first run) to the vector after the piece
    for chain in chains:
        v = list(table.vectors[table.end])
        for r in reversed(chain):
            ends[r["part"], r["first"]] = v
            v = [min(r["costs"][4 * q + e] + v[e] for e in range(4)) for q in range(4)]

    # ---- and in which state each piece of such a conversation begins
    begins: dict[tuple[int, bool], int] = {}
    finals = {(c[-1]["part"], c[-1]["first"]) for c in chains}
    if chains:

        def ways(batches):
            runs, kinds, rows = pieces(batches)
            own, part = Table(costs), rows.column("part")[0].as_py() if runs else None
            out = []
            for _, s, e in runs:
                v = ends.get((part, s == 0)) if s == 0 or e == len(kinds) else None
                if v is not None:
                    after = own.number(v)[0]
                    out.append({"part": part, "first": s == 0, "to": [own.trace(kinds[s:e], after, q, False)[1] for q in range(4)]})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("first", pa.bool_()), ("to", pa.list_(pa.int32()))]))

        to = {(r["part"], r["first"]): r["to"] for r in slim.mapInArrow(ways, "part int, first boolean, to array<int>").collect()}
        for chain in chains:
            q = 0
            for r in chain:
                begins[r["part"], r["first"]] = q
                q = to[r["part"], r["first"]][q]

    # ---- the edits
    made = T.StructType([T.StructField("conv_id", conv), T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("turn", turn), T.StructField("fault", T.StringType()), T.StructField("given_role", T.StringType()), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    made_arrow = to_arrow_schema(made)

    def edited(batches):
        runs, kinds, rows = pieces(batches)
        if not runs:
            return
        own, part = Table(costs), rows.column("part")[0].as_py()
        at, letters, states, convs = [], [], [], []
        for k, (_, s, e) in enumerate(runs):
            key = (part, s == 0)
            v = ends.get(key) if s == 0 or e == len(kinds) else None
            after = own.end if v is None else own.number(v)[0]
            edits, _ = own.trace(kinds[s:e], after, begins.get(key, 0) if v is not None else 0, v is None or key in finals)
            for letter, i, q in edits:
                at.append(None if i < 0 else s + i)
                letters.append(letter)
                states.append(q)
            convs += [s] * len(edits) if e > s else []
        for b in range(0, len(at), 10_000):
            part_at, part_letters, part_states = at[b : b + 10_000], letters[b : b + 10_000], states[b : b + 10_000]
            own_rows = rows.take(pa.array(part_at, pa.int64()))
            role = [GIVEN[q][0] if x in "RI" else r for x, q, r in zip(part_letters, part_states, own_rows.column("role").to_pylist(), strict=True)]
            n = len(part_at)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("conv_id").take(pa.array(convs[b : b + 10_000], pa.int64())).combine_chunks(), pa.array([part] * n, pa.int32()), pa.array(range(b, b + n), pa.int64()), own_rows.column("turn").combine_chunks(), own_rows.column("fault").combine_chunks().cast(pa.string()),
                    own_rows.column("role").combine_chunks().cast(pa.string()), pa.array(part_letters), pa.array(role, pa.string()), pc.fill_null(own_rows.column("text").combine_chunks().cast(pa.string()), ""),
                ],
                schema=made_arrow,
            )

    return held.mapInArrow(edited, made)


def summary(repaired: DataFrame, conv_ids: DataFrame, costs: Costs | None = None) -> DataFrame:
    """One row for each of ``conv_ids``: what was found and done, and the digest of what is left.

    SHA-256 reads a conversation from end to end, so each is read by one task, as a stream of sorted rows and never as a whole.
    """
    costs = costs or Costs()
    asked = conv_ids.select("conv_id").distinct()
    heads = asked.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("at"), *[F.lit(None).cast(repaired.schema[c].dataType).alias(c) for c in ("turn", "fault", "given_role", "edit", "role", "text")])
    given = repaired.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")
    conv = repaired.schema["conv_id"].dataType
    made = T.StructType([T.StructField("conv_id", conv), *(T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    price = {"D": costs.delete, "I": costs.insert, "R": costs.rerole, "K": 0}
    from pyspark.sql.pandas.types import to_arrow_schema

    made_arrow = to_arrow_schema(made)

    def told(batches):
        now, done = None, []

        def closed() -> None:
            if now is not None:
                gaps = now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
                done.append({"conv_id": now["conv_id"], "gaps": gaps, **{c: now[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")}, "audit": "".join(now["audit"]), "repaired_sha256": now["sha"].hexdigest()})

        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] < 0:
                    closed()
                    now = {"conv_id": r["conv_id"], "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "role": None, "any": False}
                    continue
                edit = r["edit"]
                now["audit"].append(edit)
                now["cost"] += price[edit] + (costs.truncated if r["fault"] == "truncated" and edit != "D" else 0)
                if r["fault"]:
                    now[r["fault"]] += 1
                if edit != "I":
                    if now["role"] is not None and now["role"][:1] + r["given_role"][:1] not in ("su", "ua", "au"):
                        now["illegal"] += 1
                    now["role"] = r["given_role"]
                    if r["turn"] is not None and r["turn"] != now["high"]:
                        now["low"] = r["turn"] if now["low"] is None else now["low"]
                        now["high"] = r["turn"]
                        now["turns"] += 1
                if edit != "D":
                    now["sha"].update((("\n" if now["any"] else "") + f"{r['role']}:{r['text']}").encode())
                    now["any"] = True
            if len(done) >= 1_000:
                yield pa.RecordBatch.from_pylist(done, made_arrow)
                done.clear()
        closed()
        if done:
            yield pa.RecordBatch.from_pylist(done, made_arrow)

    return given.mapInArrow(told, made)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the faults that the query of this operator plants, chosen by crc32 of ``conv_id:turn``."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    what = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    out = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), what.alias("what")).filter("what <> 0")
    out = out.withColumn("text", F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("what") == 4, "user").otherwise(F.col("role")))
    return out.withColumn("copy", F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")
