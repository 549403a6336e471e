"""Secret scans by rules and by character Markov models, with DataFrame functions only.

Rules give the base spans; a rule's match that is too short is dropped after matching, so it still uses up its text. The method
adds spans of kind ``markov``: runs of ``TOKEN`` characters that touch no base span and whose log-likelihood ratio, under first-order
Markov models of random strings against one of ordinary identifiers, is above ``MARGIN`` a character and ``LEAST`` in all.

The models are trained from labelled samples. Random strings, labels 1 to 6: digests in several alphabets, each with a model of its own,
of which the likeliest counts. Ordinary identifiers, label 0: words of the texts, alone and joined as people join them
(snake_case, kebab-case, CamelCase, camelCase, CONSTANTS, paths, with numbers). The words are those of at most about
``SAMPLE`` documents, chosen by hash, and ``ORDINARY``. A pair that is rare among them has its share of what the pair has
in any case and the second character alone. Only the tables of character pairs reach the driver.

Places are code points, ends exclusive. Null text is empty text; one row for each row of the table. Matches are added up in
blocks of ``BLOCK``, so that a text's time grows with its length; only a run above the margin is compared with all base spans of its text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contract: the base rules.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

TOKEN = r"[A-Za-z0-9+/_=-]{14,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Alphabets of the random strings: hexadecimal in lower and upper case, capitals and digits, base 62, base 64 and its form for URLs.
LABELS = 6
MARGIN, LEAST = 1.0, 18.0
#: What a character's followers in any case, and all characters, count for beside its own pairs.
FOLDED, ALONE = 60.0, 20.0
#: Fixed words of programs, the other part of the labelled sample.
ORDINARY = (
    "access action add address after agent align all allow alpha apply area async attach audio auth auto back base batch before begin bind bit block body bool bound branch bridge browser build bundle button call callback cancel case catch channel check child choose clear click clock clone close cloud cluster collect color command common compare compile compute connect const contain content context control convert copy core create current cursor custom daily data database date debug decode default define depth deploy detail device diff disable dispatch display document domain done double download draw driver dump dynamic edge edit element empty enable encode engine ensure env equal escape event exact except execute exist expand expect extend extra fail fallback feature fetch field filter final find first flag flat flow flush focus font force form format forward frame free from full gather generate global group handle hash head height hidden hook host icon id ignore image init inner input insert inspect invalid item iterate job join jump keep label last launch layer layout lazy left length level library limit line link list load local lock log login long loop make manage mark mask master match member memory merge meta method mode model monitor mount mouse move multi"
)
SAMPLE = 500
RANDOM = 4_096
BLOCK = 64
SPANS = "array<struct<s:int,k:int,e:int>>"


def spans(text: Column, rule: str, kind: int, least: int = 0, token: bool = False) -> Column:
    """All matches of a rule as (s, kind, e); with ``least``, only those whose group 2 has as many characters; with ``token``, (s, e, token)."""
    whole, gaps = F.regexp_extract_all(text, F.lit(rule), F.lit(0)), F.split(text, rule, -1)
    part = F.regexp_extract_all(text, F.lit(rule), F.lit(2)) if least else whole
    none = F.array().cast("array<struct<s:int,e:int,token:string>>" if token else SPANS)
    made = lambda s, e, x: F.struct(s.alias("s"), e.alias("e"), x["t"].alias("token")) if token else F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"))
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    matches = F.zip_with(F.zip_with(gaps, whole, lambda g, w: F.struct(size(g).alias("g"), size(w).alias("w"), (w if token else F.lit(None)).alias("t"))), part, lambda x, p: F.struct(x["g"].alias("g"), x["w"].alias("w"), x["t"].alias("t"), size(p).alias("p")))
    # Matches are added up in blocks, then the blocks' sizes: an array that grows by one is copied each time.
    step = lambda a, z: F.struct(
        (a["at"] + z["g"] + z["w"]).alias("at"),
        F.when((z["w"] > 0) & (z["p"] >= least), F.concat(a["out"], F.array(made(a["at"] + z["g"], a["at"] + z["g"] + z["w"], z)))).otherwise(a["out"]).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    cut = lambda found: F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(found, b * BLOCK + 1, BLOCK), start, step))
    place = lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["from"], F.array(a["at"])).alias("from"))
    starts = lambda blocks: F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("from")), place, lambda a: a["from"])
    moved = lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), lambda x, at: F.transform(x["out"], lambda y: made(y["s"] + at, y["e"] + at, F.struct(y["token"].alias("t")) if token else y))))
    once = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)  # noqa: E731  a lambda's argument is computed once
    return F.when(text.rlike(rule), once(once(matches, cut), moved)).otherwise(none)


def written(found: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.element_at(name, x["k"]), x["s"], x["e"])), ",")


def random_strings(spark: SparkSession, n: int = RANDOM, seed: int = 3) -> DataFrame:
    """(label, token): ``n`` random strings of each alphabet, of 16 to 48 characters."""
    digest = lambda k: F.sha2(F.concat(F.lit(f"{seed}:{k}:"), F.col("id").cast("string")), 256)
    ids = spark.range(n).select("id", digest(0).alias("h"), F.base64(F.unhex(F.concat(digest(1), digest(2)))).alias("b"))
    bare = F.translate(F.col("b"), "+/=", "")
    forms = [F.col("h"), F.upper("h"), F.regexp_replace(F.upper(bare), "[018]", ""), bare, F.translate("b", "=", ""), F.translate("b", "+/=", "-_")]
    cut = lambda c: F.substring(c, F.lit(1), (F.lit(16) + F.col("id") % 33).cast("int"))
    return ids.select(F.explode(F.array(*[F.struct(F.lit(k + 1).alias("label"), cut(c).alias("token")) for k, c in enumerate(forms)])).alias("x")).select("x.*")


def identifiers(texts: DataFrame, text: str = "text", seed: int = 3) -> DataFrame:
    """(label 0, token): three words that follow each other in a text, joined in one of the usual ways, which a hash chooses."""
    words = F.regexp_extract_all(F.col(f"`{text}`"), F.lit("[A-Za-z]{2,}"), F.lit(0))
    three = texts.select(words.alias("w")).filter(F.size("w") > 2).select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 3, F.lit(3)), lambda i: F.slice(F.col("w"), i + 1, 3))).alias("w"))
    h = F.xxhash64(F.lit(seed), "w")
    number = F.pmod(h, F.lit(10_000)).cast("string")
    low = F.transform("w", F.lower)
    title = F.array_join(F.transform("w", F.initcap), "")
    first = F.element_at(low, 1)
    forms = [
        F.array_join(low, "_"), F.array_join(low, "-"), title, F.concat(first, F.array_join(F.transform(F.slice("w", 2, 2), F.initcap), "")), F.upper(F.array_join("w", "_")), F.array_join("w", "/"),
        F.concat_ws("_", *[F.element_at(low, k) for k in (1, 2)], number), F.concat(title, number), F.concat_ws("-", F.lit("2"), number, first), F.array_join("w", "=")
    ]
    return three.select(F.lit(0).alias("label"), F.element_at(F.array(*forms), (F.pmod(F.shiftright(h, 20), F.lit(len(forms))) + 1).cast("int")).alias("token"))


def _pairs(tokens: DataFrame) -> DataFrame:
    """Counts of character pairs (label, i, j) of the column token."""
    at = lambda k: F.instr(F.lit(ALPHABET), F.substring(F.col("token"), F.col("k") + k, F.lit(1)))
    ks = tokens.filter(F.length("token") > 1).select("label", "token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("k"))
    return ks.select("label", at(0).alias("i"), at(1).alias("j")).filter("i > 0 and j > 0").groupBy("label", "i", "j").agg(F.count(F.lit(1)).alias("n"))


def _smooth(counts: list[list[float]]) -> list[list[float]]:
    """Probabilities of pairs: own counts, with shares of what they are in any case and of the second character."""
    n = len(ALPHABET)
    low = [ALPHABET.index(c.lower()) for c in ALPHABET]
    folded, single = [[0.0] * n for _ in range(n)], [1.0] * n
    for i in range(n):
        for j in range(n):
            folded[low[i]][low[j]] += counts[i][j]
            single[j] += counts[i][j]
    size = [low.count(k) for k in range(n)]
    out = []
    for i in range(n):
        f, own, every = folded[low[i]], sum(counts[i]), sum(single)
        whole = sum(f) or 1.0
        out.append([(counts[i][j] + FOLDED * f[low[j]] / whole / size[low[j]] + ALONE * single[j] / every) / (own + FOLDED * (sum(f) > 0) + ALONE) for j in range(n)])
    return out


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE, n_random: int = RANDOM, seed: int = 3) -> list[list[float]]:
    """For each character pair, row by row of the first character: the log-likelihood ratios of the random alphabets."""
    part = sample / max(1, docs.count())
    chosen = docs.filter((F.pmod(F.xxhash64(F.lit(7), text), F.lit(1 << 30)) / float(1 << 30)) < part)
    n = len(ALPHABET)
    counts = [[[0.0 if k == 0 else 0.01] * n for _ in range(n)] for k in range(LABELS + 1)]
    spark = docs.sparkSession
    fixed = spark.range(64).select(_dealt_words().alias("t"))
    names = identifiers(chosen.select(F.col(f"`{text}`").alias("t")).unionByName(fixed), "t", seed)
    for r in _pairs(names.unionByName(random_strings(spark, n_random, seed))).collect():  # at most 7 * 67 * 67 rows
        counts[r["label"]][r["i"] - 1][r["j"] - 1] += r["n"]
    plain = _smooth(counts[0])
    total = [[sum(row) for row in c] for c in counts]
    return [[math.log(counts[k][i][j] / total[k][i]) - math.log(plain[i][j]) for k in range(1, LABELS + 1)] for i in range(n) for j in range(n)]


def _dealt_words() -> Column:
    """The fixed words in an order that the column id decides."""
    words = F.transform(F.split(F.lit(ORDINARY), " "), lambda w: F.struct(F.xxhash64(w, F.col("id")).alias("h"), w.alias("w")))
    return F.array_join(F.transform(F.array_sort(words), lambda x: x["w"]), " ")


def ratio(token: Column, table: list[list[float]]) -> Column:
    """The highest log-likelihood ratio of a token, over the alphabets."""
    chars = F.filter(F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c)), lambda j: j > 0)
    pairs = F.zip_with(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.size(chars)), lambda i, j: (i - 1) * len(ALPHABET) + j)
    # A table is one text literal, which Catalyst folds into an array of doubles.
    held = [F.split(F.lit(",".join(f"{row[k]:.6f}" for row in table)), ",").cast("array<double>") for k in range(LABELS)]
    return F.greatest(*[F.aggregate(pairs, F.lit(0.0), _adder(t)) for t in held])


def _adder(table: Column):
    return lambda s, x: s + F.element_at(table, x)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", margin: float = MARGIN, least: float = LEAST) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row."""
    table = train(docs, text)
    body = F.col("text")
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", spans(body, ASSIGN, 1, 6).alias("assign"), spans(body, ACCESS, 2).alias("access"), spans(body, HEX, 3).alias("hex"), spans(body, TOKEN, 4, token=True).alias("tokens"))
    base = F.concat("assign", "access", "hex")
    free = lambda t: ~F.exists(base, lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"]))
    found = F.filter("tokens", lambda t: (ratio(t["token"], table) > F.greatest(F.lit(least), margin * F.length(t["token"]))) & free(t))
    more = F.transform(found, lambda t: F.struct(t["s"].alias("s"), F.lit(4).alias("k"), t["e"].alias("e")))
    done = rows.select("doc_id", "assign", "access", "hex", base.alias("base"), F.when(F.size("tokens") > 0, F.concat(base, more)).otherwise(base).alias("every"))
    n = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return done.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("every")).alias("spans"))

