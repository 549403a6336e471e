"""The n-gram join at its threshold, and on blocks that are cut into chunks."""

import random

import numpy as np
import pytest

from lodestone.llm import common, ngram_join
from lodestone.llm.common import U
from tests.llm.test_operators import brute_components, documents, prose


def pair_at(t, n, r):
    """Sizes and overlap of a pair of sets just at the threshold, the larger one of n shingles."""
    for both in range(n, 0, -1):
        # den * both >= num * (n + b - both), b as large as the pair still links
        b = min(n, (t.den * both) // t.num + both - n)
        if both <= b < n or both < n <= b:
            if not t.den * (both - 1) >= t.num * (n + b - (both - 1)) and r.random() < 0.3:
                return n, b, both
    return n, n, n


@pytest.mark.parametrize(("num", "den"), [(9, 10), (8, 10)])
def test_recall_at_the_threshold(num, den):
    """Sets at the threshold share a fingerprint: thousands of pairs, over all sizes."""
    t, g, r, missed, tried = ngram_join.Threshold(num, den), np.random.default_rng(num), random.Random(num), 0, 0
    for _ in range(60):
        sets, pairs = [], 0
        for _ in range(60):
            n, b, both = pair_at(t, int(2 ** r.uniform(1, 12)), r)
            if n == b == both or t.den * both < t.num * (n + b - both):
                continue
            h = g.integers(0, 1 << 64, n + b - both, dtype=np.uint64)
            sets += [np.sort(h[:n]), np.sort(h[n - both :])]
            pairs += 1
        sig, row = ngram_join.fingerprints(np.concatenate(sets), np.array([len(s) for s in sets]), t)
        of = [set() for _ in sets]
        for s, k in zip(sig.tolist(), row.tolist(), strict=True):
            of[k].add(s)
        missed += sum(not of[2 * k] & of[2 * k + 1] for k in range(pairs))
        tried += pairs
    assert tried > 2000 and missed == 0


@pytest.mark.parametrize(("num", "den"), [(9, 10), (8, 10)])
def test_first_shingles_are_exact(num, den):
    t, g, r = ngram_join.Threshold(num, den), np.random.default_rng(num), random.Random(num)
    sketch = np.random.default_rng(1).integers(2, 5, 1 << ngram_join.SKETCH_BITS).astype(np.uint16)
    for _ in range(2000):
        n, b, both = pair_at(t, r.randint(1, 60), r)
        h = g.integers(0, 1 << 64, n + b - both, dtype=np.uint64)
        x, y = np.sort(h[:n]), np.sort(h[n - both :])
        sig, row = ngram_join.prefixes(np.concatenate([x, y]), np.array([len(x), len(y)]), t, sketch)
        assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist()) or den * both < num * (n + b - both)


def test_overlaps_keep_all_links():
    t, g = ngram_join.Threshold(8, 10), np.random.default_rng(3)
    base = g.integers(0, 1 << 64, 5000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([g.permutation(base)[: int(5000 * s)], g.integers(0, 1 << 64, 200, dtype=np.uint64)])) for s in g.uniform(0.7, 1, 40)]
    counts = np.array([len(s) for s in sets])
    a, b = ngram_join.overlaps(np.concatenate(sets).astype(U), counts, np.arange(40), t, width=256)
    want = {(i, j) for i in range(40) for j in range(40) if i != j and 10 * (o := len(np.intersect1d(sets[i], sets[j]))) >= 8 * (counts[i] + counts[j] - o)}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and 0 < len(want) < 1560


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 8, 10)])
def test_large_blocks(spark, n, num, den):
    """Variants of a text that link with it alone, a chain, texts that only share a passage: with chunks of 4 rows."""
    r = random.Random(4)
    base, passage = prose(1, 150).split(), prose(2, 120)
    texts = [" ".join(base)]
    for k in range(30):
        w = list(base)
        for _ in range(2 if n == 3 else 3):
            w[r.randrange(len(w))] = f"new{k}"
        texts.append(" ".join(w))
    for k in range(12):
        texts.append(" ".join(w[: 150 - k] + [f"end{i}" for i in range(k)]))
        texts.append(passage + " " + prose(50 + k, 12 + k))
    texts += ["short text of six words here", texts[3], texts[3]]
    want = brute_components(texts, n, num, den)
    docs = documents(spark, texts).repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.join(docs, n, num, den, chunk=4).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert len({c for _, c in want}) < len(texts) - 20


def test_a_doc_id_with_two_texts(spark):
    a, b = prose(1, 50), prose(2, 50)
    docs = documents(spark, [a, b, a, b]).withColumn("doc_id", __import__("pyspark.sql.functions", fromlist=["x"]).expr("if(doc_id = 1, 0, doc_id)"))
    got = sorted((x.doc_id, x.component_id) for x in ngram_join.join(docs, 3, 9, 10).collect())
    assert got == [(0, 0), (0, 0), (2, 0), (3, 0)]
    assert common.components(docs.limit(0).selectExpr("doc_id as src", "doc_id as dst")).count() == 0


def test_ids_above_the_limit_are_shuffled(spark, monkeypatch):
    """What the driver sends stays small; above it the texts outside of all blocks are left behind once."""
    assert ngram_join.SEND_ROWS * 9 * 8 <= 4 << 20 and ngram_join.SEND_IDS * 2 * 8 <= 4 << 20
    texts = [prose(k // 2, 40) + (" tail" if k % 2 else "") for k in range(12)] + [prose(50 + k, 30) for k in range(20)] + [None]
    docs, read, texts_of = documents(spark, texts).repartition(3), [], ngram_join.Job.texts
    kept = sorted(r.doc_id for r in ngram_join.keep_one(docs).collect())
    assert kept == [*range(0, 12, 2), *range(12, 33)]
    monkeypatch.setattr(ngram_join.Job, "texts", lambda job, ids, n: read.append(job.docs.count()) or texts_of(job, ids, n))
    for name in ("SEND_ROWS", "SEND_IDS"):
        monkeypatch.setattr(ngram_join, name, 3)
    found = ngram_join.join(docs, chunk=4)
    assert [(r.doc_id, r.component_id) for r in found.orderBy("doc_id").collect()] == [(k, k - k % 2 if k < 12 else k) for k in range(33)]
    assert read and max(read) == 12
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs).collect()) == kept


def test_few_edges_take_no_rounds(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 300) if k % 50] + [(900, 7), (7, 900), (5, 5), (-3, 901)], "src long, dst long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few", "few")
    found = sorted(map(tuple, common.components(edges).collect()))
    jobs = len(tracker.getJobIdsForGroup("few"))
    spark.sparkContext.setJobGroup("rounds", "rounds")
    assert found == sorted(map(tuple, common.components(edges, few=0).collect())) and (900, 1) in found and (901, -3) in found
    assert jobs < 10 < len(tracker.getJobIdsForGroup("rounds"))
    assert common.components(edges.filter("src = dst")).count() == 0
