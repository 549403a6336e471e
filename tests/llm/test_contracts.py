"""Cases of the contracts that single operators' tests don't cover: letters, clashing names, empty tables, strings that no rule knows."""

import random
import string

import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, decontaminate, lang_id, secret_scan, units

DATA = "/root/testdata/sf0.001"


def test_number_signs_are_no_letters():
    assert lang_id.words_in("½ ² ① Ⅷ 12 _ ٣ !") == []
    assert lang_id.words_in("Straße½und x²y Ünï") == ["straße", "und", "x", "y", "ünï"]


def test_texts_without_letters_have_no_language(spark):
    docs = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 10 + [("½ ② ①", "en"), ("", "de"), (None, "en"), ("123 !?", None)])]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("own")).withColumn("score", F.lit("own"))
    model = lang_id.train(df.filter(~lang_id.held_out()))
    got = {r["doc_id"]: r for r in lang_id.classify(df, model).collect()}
    assert [got[k]["lang_pred"] for k in range(20, 24)] == ["und"] * 4 and {got[0]["lang_pred"], got[1]["lang_pred"]} == {"en", "de"}
    assert set(lang_id.classify(df, model).columns) == {"doc_id", "text", "lang", "lang_pred", "score"}


@pytest.mark.parametrize("block", [4_000_000, 40])
def test_a_table_with_own_hits(spark, block):
    docs = spark.createDataFrame([(1, "some words of the benchmark item in here", "x", "y"), (1, "some words of the benchmark item in here", "x", "y"), (2, "nothing", None, "z"), (3, None, "w", "v")], "doc_id long, text string, hits string, earlier0 string")
    items = spark.createDataFrame([(7, "words of the benchmark item"), (8, "quite another thing altogether"), (9, None)], "item_id long, text string")
    out = decontaminate.scan(docs, items, block_chars=block)
    assert sorted(out.columns) == ["doc_id", "earlier0", "hits", "text"]
    assert sorted((r["doc_id"], r["earlier0"], [h["item_id"] for h in r["hits"]]) for r in out.collect()) == [(1, "y", [7]), (1, "y", [7]), (2, "z", []), (3, "v", [])]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, hits string")
    assert units.repeated_units(none).count() == units.repeated_windows(none).count() == secret_scan.scan(none).count() == 0
    assert decontaminate.scan(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_planted_strings_that_no_rule_knows(spark):
    """Over a whole table, strings of random letters are found among its own words, which are left alone."""
    try:
        docs = common.read(spark, DATA, "documents").select("doc_id", "text")
        rows = docs.collect()
    except Exception:
        pytest.skip("no test tables")
    rng, planted, out = random.Random(12), {}, []
    for r in rows:
        text = r["text"] or ""
        if rng.random() < 0.5:
            secret = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(24, 40)))
            text = f"{text}\n{secret}"
            planted[r["doc_id"]] = len(text) - len(secret), len(text)
        out.append((r["doc_id"], text))
    before = {r["doc_id"]: r["spans"].split(",") if r["spans"] else [] for r in secret_scan.scan(docs).collect()}
    after = {r["doc_id"]: r["spans"].split(",") if r["spans"] else [] for r in secret_scan.scan(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    added = {d: [tuple(map(int, s.split(":")[1:])) for s in own if s not in before[d]] for d, own in after.items()}
    found = sum(planted[d] in added[d] for d in planted)
    wrong = sum(s != planted.get(d) for d, own in added.items() for s in own)
    assert found >= 0.97 * len(planted) and wrong <= 0.02 * len(rows)
