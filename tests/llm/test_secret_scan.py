"""The Markov models of the secret scan on held-out strings and identifiers, and against a plain recomputation."""

import math
import random
import string
import time

import pytest
from pyspark.sql import functions as F

from lodestone.llm import secret_scan
from tests.llm.test_operators import documents, prose

#: None of them is one of the words that the model is trained with.
WORDS = "get set user account balance manager factory config value index number max min retry count stamp service client request response parse token stream buffer writer reader thread pool queue tree graph vector matrix kernel package export error message status code version update delete select table column row key map array string integer float boolean byte file path directory name type class object function variable parameter argument return".split()
ALPHABETS = [string.ascii_letters + string.digits, "0123456789abcdef", "0123456789ABCDEF", string.ascii_letters + string.digits + "+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]


@pytest.fixture(scope="module")
def table(spark):
    return secret_scan.train(documents(spark, [prose(k, 200) for k in range(40)] + [None, ""]))


def held_out(r, n):
    names, keys = [], []
    while len(names) < n:
        w = [r.choice(WORDS) for _ in range(r.randint(2, 4))]
        title = "".join(a.title() for a in w)
        x = r.choice(["_".join(w), title, title[0].lower() + title[1:], "_".join(w).upper(), "-".join(w), "_".join(w) + str(r.randrange(1000))])
        names += [x] if len(x) >= 14 else []
    for _ in range(n):
        keys.append("".join(r.choice(ALPHABETS[len(keys) % 5]) for _ in range(r.randint(16, 44))))
    return names, keys


def test_held_out_strings(spark, table):
    names, keys = held_out(random.Random(5), 1500)
    rows = spark.createDataFrame([(0, x) for x in names] + [(1, x) for x in keys], "label int, token string")
    found = rows.filter(secret_scan.ratio(F.col("token"), table) > F.greatest(F.lit(secret_scan.LEAST), secret_scan.MARGIN * F.length("token"))).groupBy("label").count()
    got = {r["label"]: r["count"] for r in found.collect()}
    assert got[1] >= 0.97 * len(keys) and got.get(0, 0) <= 0.02 * len(names)


def test_ratio_is_the_best_alphabet(spark, table):
    _, keys = held_out(random.Random(6), 60)
    tokens = [*keys, "a", "ab", "snake_case_name", ""]
    got = [r.x for r in spark.createDataFrame([(x,) for x in tokens], "token string").select(secret_scan.ratio(F.col("token"), table).alias("x")).collect()]
    at = secret_scan.ALPHABET.index
    want = [max(sum(table[at(a) * len(secret_scan.ALPHABET) + at(b)][k] for a, b in zip(x, x[1:])) for k in range(secret_scan.LABELS)) for x in tokens]
    assert all(math.isclose(a, b, abs_tol=1e-3) for a, b in zip(got, want, strict=True))


def test_models_are_probabilities():
    counts = [[0.0] * len(secret_scan.ALPHABET) for _ in secret_scan.ALPHABET]
    counts[0][1], counts[26][27], counts[5][5] = 7.0, 2.0, 1.0
    assert all(math.isclose(sum(row), 1) and min(row) > 0 for row in secret_scan._smooth(counts))


def test_long_texts(spark):
    begun = time.time()
    texts = ["password=abcdefgh " * 40_000, "x" * 1_000_000, " ".join("ab" * 12 for _ in range(20_000)), "AKIA" + "A" * 500_000]
    got = {r.doc_id: r for r in secret_scan.scan(documents(spark, texts)).collect()}
    assert got[0].n_assign == 40_000 and got[0].spans.startswith("assign:0:17,assign:18:35") and got[0].spans.endswith("assign:719982:719999")
    assert got[2].n_hex == 20_000 and got[2].spans.endswith(f"hex:{19_999 * 25}:{19_999 * 25 + 24}") and got[3].n_access == 1
    assert time.time() - begun < 90
