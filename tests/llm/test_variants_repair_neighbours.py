"""Spelling variants, conversation repair and the permutation index against brute force."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import conversation_repair as cr
from lodestone.llm import oracles, permutation_index, variants

# ---------------------------------------------------------------- conversations

SCHEMA = "conv_id long, turn long, role string, text string, fault string, hits int, part int"


def best_edits(rows):
    """All edits of (initial, fault, role) tried: the least cost, then the least string; and what is left."""
    reads = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    given = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
    todo, best = [(0, "", 0, 0, ())], None
    seen = set()
    while todo:
        cost, audit, i, q, left = heapq.heappop(todo)
        if i == len(rows) and q in (0, 3):
            best = (cost, audit, left)
            break
        if (i, q) in seen:
            continue
        seen.add((i, q))
        role, to = given[q]
        heapq.heappush(todo, (cost + 5, audit + "I", i, to, (*left, f"{role}:")))
        if i < len(rows):
            own, text, fault = rows[i]
            heapq.heappush(todo, (cost + 2, audit + "D", i + 1, q, left))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if own[:1] in reads[q]:
                    heapq.heappush(todo, (cost + more, audit + "K", i + 1, reads[q][own[:1]], (*left, f"{own}:{text}")))
                heapq.heappush(todo, (cost + more + 1, audit + "R", i + 1, to, (*left, f"{role}:{text}")))
    return best


def by_hand(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, " " if r is None else r, " " if x is None else x) for c, t, r, x, *_ in rows if c == conv), key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))
        seen, told = set(), []
        for _, role, text in own:
            bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            told.append((role, text, fault))
        cost, audit, left = best_edits(told)
        turns = {t for t, _, _ in own if t is not None}
        counts = [sum(f == x for *_, f in told) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(told))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def repaired(spark, rows, partitions=None):
    given = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    if partitions:
        given = given.repartition(partitions)
    return {r["conv_id"]: tuple(r)[1:] for r in cr.summary(cr.repair(given), given).collect()}


def some_rows(rng, convs, most):
    texts = ["Yes.", "No", "Why?", "", "  ", None, "So. ", "and\n", "Done!\t"]
    return [(c if c else None, rng.choice([None, t, t, t]), rng.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"]), rng.choice(texts)) for c in range(convs) for t in range(rng.randint(0, most))]


def test_repairs_as_all_edits_tried(spark):
    rows = some_rows(random.Random(7), 60, 12)
    assert repaired(spark, rows) == by_hand(rows)


def test_one_conversation_over_many_ranges(spark):
    """A conversation that holds nearly all rows is cut; what its ranges exchange gives the same edits."""
    rng = random.Random(8)
    rows = [(5, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", "Why? ", "", "t%d." % (t % 90), "u%d!" % t])) for t in range(1500)] + [(4, 1, "user", "Hm."), (6, 0, "assistant", "Hm."), (6, 1, "user", "Hm")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        given = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
        out = cr.repair(given)
        assert out.filter("conv_id = 5").select("part").distinct().count() > 3
        assert {r["conv_id"]: tuple(r)[1:] for r in cr.summary(out, given).collect()} == by_hand(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_conversations_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cr.repair(none).count() == 0
    heads = spark.createDataFrame([(1,), (None,), (1,)], "conv_id long")
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, cr.summary(cr.repair(none), heads).collect()), key=str) == [(1, 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)]


def test_very_long_and_repeated_rows(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "x." * 300_000)]
    assert repaired(spark, rows) == by_hand(rows)


def test_states_of_the_table_are_few():
    table, rng = cr.Table(cr.Costs()), random.Random(3)
    table.scan(bytes(rng.randint(0, 8) for _ in range(20_000)), table.end)
    assert len(table.vectors) < 40 and all(min(v) == 0 for v in table.vectors)


def test_damage_is_that_of_the_checksum(spark):
    rows = [(c, t, "assistant", "One. Two? Three!") for c in range(40) for t in range(5)]
    want = []
    for c, t, role, text in rows:
        what = zlib.crc32(f"{c}:{t}".encode()) % 20
        if what:
            want += [(c, t, "user" if what == 4 else role, "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text)] * (2 if what == 3 else 1)
    got = cr.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


# ---------------------------------------------------------------- words


def near_by_hand(counts):
    near = {w: set() for w in counts}
    for x, y in itertools.combinations(counts, 2):
        if abs(len(x) - len(y)) <= 1:
            long, short = (x, y) if len(x) >= len(y) else (y, x)
            hit = sum(a != b for a, b in zip(x, y, strict=True)) == 1 if len(x) == len(y) else any(long[:i] + long[i + 1 :] == short for i in range(len(long)))
            if hit:
                near[x].add(y)
                near[y].add(x)
    form = {}
    for w in counts:
        top = min(((-counts[y], y) for y in near[w]), default=None)
        form[w] = top[1] if top and -top[0] >= 10 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def vocabulary(rng):
    words = set()
    while len(words) < 250:
        base = "".join(rng.choice("abé") for _ in range(rng.randint(7, 11)))
        words |= {base, base + "a", base[:3] + base[4:], base[:5] + "b" + base[5:], "aaaaaaa" + base[:3]}
    return {w: rng.choice([2, 3, 25, 300, 4000]) for w in sorted(words) if len(w) >= 7}


@pytest.mark.parametrize("limits", [{}, {"shard": 50, "common_above": 15}, {"shard": 200, "common_above": 4}])
def test_near_words_as_all_pairs(spark, limits):
    """Also where halves are so common that they are cut before and within the shards."""
    counts = vocabulary(random.Random(11))
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: (r["n"], r["near"]) for r in variants.near_words(words, **limits).collect()}
    want = near_by_hand(counts)
    assert got == {w: (n, k) for w, _, _, n, k, _ in want}
    assert set(map(tuple, variants.group(words).collect())) == want


def test_a_shard_with_one_common_half():
    """Entries with one half in common are cut down to where few remain, and none is lost."""
    rng = random.Random(2)
    words = sorted({"common" + "".join(rng.choice("xyz") for _ in range(6)) for _ in range(500)})
    shard = variants.Shard([(w, 5, s, e) for w in words for s, e in variants.halves(len(w))], 4)
    for w in words[:100]:
        assert sorted(x for x, _ in shard.near(w)) == [x for x in words if sum(a != b for a, b in zip(x, w, strict=True)) == 1]


def test_words_of_texts(spark):
    docs = [(k, t, "src", "x") for k, t in enumerate(["Straße ÄÖÜäöüß Éclairs× naïveté " * 3, None, "", "x" * 70_000 + " short words only", "Variants variants VARIANTS vari-ants", "x" * 70_000, "Variants"])] + [(None, "Variants nulldoc nulldoc", "s", "x")]
    counts = {}
    for k, t, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if k is None else k}:{low}".encode())
            w = low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low
            if len(w) >= 7:
                counts[w] = counts.get(w, 0) + 1
    got = variants.word_counts(spark.createDataFrame(docs, "doc_id long, text string, word string, n string"))
    assert {tuple(r) for r in got.collect()} == {(w, n) for w, n in counts.items() if n >= 2}


def test_no_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group(variants.word_counts(none)).count() == 0


# ---------------------------------------------------------------- vectors


def nearest_by_hand(rows, k, every):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % every == 0:
            d = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, x in good if i != q and len(x) == len(v))
            out.setdefault(q, set()).update(d)
    return {q: sorted(d)[:k] for q, d in out.items()}


def test_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(3000, 24)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = nearest_by_hand(rows, 10, 100)
    got = {}
    for r in permutation_index.Index(table, 100, shard_rows=700, query_rows=8).search(10).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = (r["rank"], r["score"])
    assert set(got) == set(want) and all(sorted(x for x, _ in own.values()) == list(range(1, 11)) for own in got.values())
    hits = [got[q].get(i) for q, own in want.items() for _, i in own]
    assert sum(h is not None for h in hits) >= 0.9 * len(hits)
    vectors = {i: np.array(v) for i, v in rows}
    for q, own in got.items():
        assert [s for _, s in sorted(own.values())] == sorted(s for _, s in own.values())
        assert all(s == pytest.approx(float(np.linalg.norm(vectors[q] - vectors[i])), rel=1e-12) for i, (_, s) in own.items())


def test_a_full_depth_is_exact_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(400)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(400, 700)] + [(700, None), (800, [0.0] * 4), (900, [1.0, None, 0.0, 0.0]), (1000, [math.nan, 1.0, 1.0, 1.0]), (1100, [math.inf, 1.0, 1.0, 1.0]), (None, [1.0] * 4), (1200, [1.0, 2.0]), (1201, [2.0, 2.0]), (1300, []), (1300, [9.0] * 3), (100, rows[100][1]), (200, [5.0] * 4)]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<double>, rank string, score int")
    got = {}
    for r in permutation_index.Index(table, 100, shard_rows=90, query_rows=3).search(10, depth=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    want = {q: [(k + 1, s, i) for k, (s, i) in enumerate(own)] for q, own in nearest_by_hand(rows, 10, 100).items() if own}
    assert {q: [(k, i) for k, _, i in sorted(own)] for q, own in got.items()} == {q: [(k, i) for k, _, i in own] for q, own in want.items()}
    assert all(x[1] == pytest.approx(y[1]) for q in want for x, y in zip(sorted(got[q]), want[q], strict=True))


def test_no_vectors(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(0, [1.0, 2.0])], [(0, None)]):
        assert permutation_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_footrule_from_postings():
    rng = np.random.default_rng(4)
    x, pivots = rng.normal(size=(50, 6)), rng.normal(size=(20, 6))
    places = permutation_index.places_of(x, pivots, 8)
    want = np.abs(places.astype(int) - places[7].astype(int)).sum(1)
    got = permutation_index.Postings(places, 8).footrule(places[7])
    assert (got - got[7] == want).all()


# ---------------------------------------------------------------- SQL

DATA = "/root/testdata/sf0.001"


def test_recall_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    try:
        con.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    except duckdb.Error:
        pytest.skip("no test tables")
    want = {(q, i): s for q, _, i, s in con.execute(oracles.NEIGHBOURS).fetchall()}
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in permutation_index.nearest(spark.read.parquet(f"{DATA}/embeddings.parquet").withColumn("rank", F.lit(1))).collect()}
    assert len(got) == len(want) and sum(k in got for k in want) >= 0.9 * len(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want if k in got)
