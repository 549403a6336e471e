"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum,
over all ways to cut it into pieces, of the product of the pieces' probabilities (forward algorithm); a text's is the product over
its words. Words are runs of letters in lower case, with the vocabulary's mark for a word's start in front; letters that the
vocabulary doesn't hold cost ``FLOOR``. Words of any length are summed over all their segmentations: those of up to ``SHORT`` letters
many at a time, longer ones (as in scripts without spaces) one by one in logarithms.

Training is expectation maximisation on at most about ``sample`` labelled rows a language (all rows when there are
fewer), chosen by hash; every language that occurs is learned. The piece counts are summed on the executors, and only
(languages x pieces) numbers reach the driver.

Null text or one without a letter: language ``und``, score 0. No labelled row: all are ``und``. Rows are
returned one for one, repeated ones too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import common

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UND = "und"
FLOOR = 1e-8
#: Letters of a word that is one of many in an array.
SHORT = 31
#: Words whose scores a task keeps, and bytes of these scores.
KEPT, KEPT_BYTES = 200_000, 64 << 20
#: Parts of a language whose texts of the lowest hashes are found apart.
SPREAD = 16
LETTERS = re.compile(r"[^\W\d_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def pieces_of(path: str = VOCABULARY) -> list[str]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: sp.IsControl(i) or sp.IsUnknown(i) or sp.IsByte(i) or sp.IsUnused(i)
    low = {p for i in range(sp.GetPieceSize()) if not special(i) and (p := sp.IdToPiece(i)) == p.lower()}
    return sorted(p for p in low if p.strip("▁").isalpha() or p == "▁")


def words_in(text: str | None) -> list[str]:
    """The runs of letters (Unicode category L) in lower case."""
    found = LETTERS.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in ("".join(c if c.isalpha() else " " for c in run)).split()]  # number signs such as ½ and ② part words


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


class Lattice:
    """Finds the pieces in words of one length."""

    #: Pieces are found in a table of this many bits; those that share a place with another are in a second one.
    BITS = 18

    def __init__(self, pieces: list[str]) -> None:
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        held = {p[:k]: self.size + 1 for p in pieces for k in range(1, len(p))} | {p: i for i, p in enumerate(pieces)}
        names, h = list(held), np.zeros(len(held), np.uint64)
        for rows in by_length(names).values():
            h[rows] = self._fold(_codes([names[k] for k in rows]))
        value = np.fromiter(held.values(), np.int64, len(held))
        self.tables, left = [], np.arange(len(held))
        for deal in range(16):
            keys, ids = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, self.size)
            at = self._at(h[left], deal)
            _, first = np.unique(at, return_index=True)
            keys[at[first]], ids[at[first]] = h[left[first]], value[left[first]]
            self.tables.append((keys, ids))
            left = np.delete(left, first)
            if not len(left):
                break

    def _at(self, h: np.ndarray, deal: int) -> np.ndarray:
        return (h >> np.uint64(64 - self.BITS - deal)) & np.uint64((1 << self.BITS) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes; ``size`` + 1 for the start of a piece, ``size`` for none."""
        out = np.full(len(h), self.size)
        for deal, (keys, ids) in enumerate(self.tables):
            at = self._at(h, deal)
            np.copyto(out, ids[at], where=keys[at] == h)
        return out

    @staticmethod
    def _fold(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for k in range(codes.shape[1]):
            h = (h + codes[:, k] + np.uint64(1)) * _MUL
            h ^= h >> np.uint64(29)
        return h

    def arcs(self, words: list[str]):
        """(start, end, row, piece) for the pieces of words with the mark; a letter without a piece has the number ``size``."""
        codes = np.hstack([np.full((len(words), 1), ord("▁"), np.uint64), _codes(words)])
        n, length = codes.shape
        for i in range(length):
            rows, h = np.arange(n), np.zeros(n, np.uint64)
            for j in range(i + 1, min(length, i + self.longest) + 1):
                h = (h + codes[rows, j - 1] + np.uint64(1)) * _MUL
                h ^= h >> np.uint64(29)
                piece = self.find(h)
                if j == i + 1:
                    yield i, j, rows, np.minimum(piece, self.size)
                elif (hit := piece < self.size).any():
                    yield i, j, rows[hit], piece[hit]
                open_ = piece != self.size  # words that some piece goes on in
                rows, h = rows[open_], h[open_]
                if not len(rows):
                    break


def forward(lattice: Lattice, words: list[str], p: np.ndarray, keep: bool = False):
    """Probability of each word (rows) in each language (columns), summed over all segmentations."""
    arcs = list(lattice.arcs(words))
    a = np.zeros((len(words[0]) + 2, len(words), p.shape[1]))
    a[0] = 1
    for i, j, rows, piece in arcs:
        if len(rows) == len(words):
            a[j] += a[i] * p[piece]
        else:
            a[j][rows] += a[i][rows] * p[piece]
    return (a, arcs) if keep else a[-1]


def _long_arcs(lattice: Lattice, word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of all pieces in one word, by end."""
    codes = np.concatenate([np.array([ord("▁")], np.uint64), _codes([word])[0]])
    at, h, found = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
    for size in range(1, lattice.longest + 1):
        at, h = at[at + size <= len(codes)], h[: np.searchsorted(at, len(codes) - size, "right")]
        h = (h + codes[at + size - 1] + np.uint64(1)) * _MUL
        h ^= h >> np.uint64(29)
        piece = lattice.find(h)
        use = np.ones(len(at), bool) if size == 1 else piece < lattice.size
        found.append((at[use], at[use] + size, np.minimum(piece[use], lattice.size)))
        open_ = piece != lattice.size
        at, h = at[open_], h[open_]
    i, j, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((i, j))
    return i[order], j[order], piece[order]


def long_forward(lattice: Lattice, word: str, logs: np.ndarray) -> np.ndarray:
    """``forward`` for one word of any length: logarithms of its probability in each language, from those of the pieces."""
    i, j, piece = _long_arcs(lattice, word)
    n = len(word) + 1
    cuts = np.searchsorted(j, np.arange(1, n + 2))
    a = np.zeros((n + 1, logs.shape[1]))
    for k in range(1, n + 1):
        arcs = slice(cuts[k - 1], cuts[k])
        x = a[i[arcs]] + logs[piece[arcs]]
        top = x.max(0)
        a[k] = top + np.log(np.exp(x - top).sum(0))
    return a[-1]


def long_expected(lattice: Lattice, word: str, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in one word of any length, forward and backward in logarithms."""
    i, j, piece = _long_arcs(lattice, word)
    n, w = len(word) + 1, np.log(p[piece])
    a, b = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    a[0] = b[n] = 0
    ends, starts = np.searchsorted(j, np.arange(1, n + 2)), np.argsort(i, kind="stable")
    begins = np.searchsorted(i[starts], np.arange(0, n + 1))
    for k in range(1, n + 1):
        a[k] = np.logaddexp.reduce(a[i[ends[k - 1] : ends[k]]] + w[ends[k - 1] : ends[k]])
    for k in range(n - 1, -1, -1):
        own = starts[begins[k] : begins[k + 1]]
        b[k] = np.logaddexp.reduce(b[j[own]] + w[own])
    return np.bincount(piece, np.exp(a[i] + w + b[j] - a[n]), lattice.size + 1)


def by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        out.setdefault(len(w), []).append(k)
    return out


def expected(lattice: Lattice, words: list[str], counts: np.ndarray, p: np.ndarray | None) -> np.ndarray:
    """Expected number of uses of each piece (the last: unknown letters) in ``words``; without ``p``, of each place it fits."""
    out = np.zeros(lattice.size + 1)
    for length, rows in by_length(words).items():
        own, c = [words[k] for k in rows], counts[rows]
        if length > SHORT:
            for w, n in zip(own, c, strict=True):
                out += n * (np.bincount(_long_arcs(lattice, w)[2], minlength=len(out)) if p is None else long_expected(lattice, w, p))
            continue
        if p is None:
            for _, _, r, piece in lattice.arcs(own):
                out += np.bincount(piece, c[r], len(out))
            continue
        a, arcs = forward(lattice, own, p[:, None], keep=True)
        b = np.zeros((len(own[0]) + 2, len(own)))
        b[-1] = 1
        for i, j, r, piece in reversed(arcs):
            b[i][r] += b[j][r] * p[piece]
        a, z = a[:, :, 0], np.maximum(b[0], 1e-300)
        for i, j, r, piece in arcs:
            out += np.bincount(piece, c[r] * a[i][r] * p[piece] * b[j][r] / z[r], len(out))
    return out


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    p: np.ndarray  # (pieces + 1) x languages


def _probabilities(counts: np.ndarray) -> np.ndarray:
    """Smoothed, a column for each language; the last row is the cost of a letter without a piece."""
    c = counts[:-1] + 0.01
    return np.vstack([c / c.sum(0), np.full((1, counts.shape[1]), FLOOR)])


def train(docs: DataFrame, path: str = VOCABULARY, sample: int = 400, rounds: int = 3) -> Model:
    """From ``docs`` (text, lang); a null lang or text teaches nothing. ``sample``: distinct texts a language, those of the lowest hashes."""
    pieces = pieces_of(path)
    docs = docs.select("text", "lang", F.xxhash64(F.lit(5), "text").alias("h")).filter("lang is not null and text is not null")
    # The lowest of parts of each language, then of these: no task has more than SPREAD * sample rows of one.
    lowest = docs.select("lang", "h").distinct().withColumn("part", F.pmod("h", F.lit(SPREAD)))
    for by in (("lang", "part"), ("lang",)):
        lowest = lowest.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("k") <= sample)
    lowest = common.checkpointed(lowest.groupBy("lang").agg(F.max("h").alias("last")))
    held = [r["lang"] for r in lowest.select("lang").collect()]
    languages = sorted(held)
    if not languages:
        return Model([], pieces, np.zeros((len(pieces) + 1, 0)))
    chosen = docs.join(F.broadcast(lowest), "lang").filter("h <= last").select("text", "lang").distinct()  # copies teach once

    def count_words(batches):
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                for w in words_in(text):
                    seen[lang, w] = seen.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(seen.values(), pa.int64())], ["lang", "word", "n"])

    words = chosen.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    p, at = None, {k: i for i, k in enumerate(languages)}
    for _ in range(rounds + 1):

        def expect(batches, p=p):
            lattice, sums = Lattice(pieces), {}
            for batch in batches:
                lang, word, n = (batch.column(c) for c in ("lang", "word", "n"))
                for k in pc.unique(lang).to_pylist():
                    own = pc.equal(lang, k)
                    found = expected(lattice, word.filter(own).to_pylist(), n.filter(own).to_numpy().astype(float), None if p is None else np.ascontiguousarray(p[:, at[k]]))
                    sums[k] = sums.get(k, 0) + found
            for k, v in sums.items():
                ids = np.flatnonzero(v > 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array([at[k]] * len(ids), pa.int32()), pa.array(ids, pa.int32()), pa.array(v[ids])], ["k", "piece", "n"])

        got = words.mapInArrow(expect, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((len(pieces) + 1, len(languages)))
        counts[got["piece"], got["k"]] = got["n"]
        p = _probabilities(counts)
    words.unpersist()
    return Model(languages, pieces, np.round(p, 12))


class Scorer:
    """Log-likelihoods of texts; short words that were scored are kept, ``KEPT`` of them in ``KEPT_BYTES`` at most."""

    def __init__(self, model: Model, most: int | None = None) -> None:
        self.lattice, self.p = Lattice(model.pieces), model.p
        self.log_p = np.log(model.p)
        self.most = most or min(KEPT, max(1_000, KEPT_BYTES // (8 * max(1, model.p.shape[1]))))
        self.known: dict[str, int] = {}
        self.logs = np.zeros((min(self.most, 1 << 14), model.p.shape[1]))

    def learn(self, words: list[str]) -> None:
        start = len(self.known)
        if len(self.logs) < start + len(words):
            more = max(start + len(words), min(2 * len(self.logs), self.most)) - len(self.logs)
            self.logs = np.vstack([self.logs, np.zeros((more, self.logs.shape[1]))])
        step = max(1, min(20_000, KEPT_BYTES // (8 * (SHORT + 2) * max(1, self.p.shape[1]))))
        for rows in by_length(words).values():
            for s in range(0, len(rows), step):
                part = rows[s : s + step]
                self.logs[start + np.array(part)] = np.log(np.maximum(forward(self.lattice, [words[k] for k in part], self.p), 1e-300))
        self.known.update(zip(words, range(start, start + len(words)), strict=True))

    def text(self, words: list[str]) -> np.ndarray:
        short = [w for w in words if len(w) <= SHORT]
        total = np.zeros(self.p.shape[1])
        for first in range(0, len(short), self.most):
            part = short[first : first + self.most]
            fresh = [w for w in dict.fromkeys(part) if w not in self.known]
            if len(self.known) + len(fresh) > self.most:
                self.known.clear()
                fresh = list(dict.fromkeys(part))
            if fresh:
                self.learn(fresh)
            total += self.logs[np.fromiter(map(self.known.__getitem__, part), np.int64, len(part))].sum(0)
        for w in words:
            if len(w) > SHORT:
                total += long_forward(self.lattice, w, self.log_p)
        return total

    def texts(self, texts: list[str | None], run: int = 1_000) -> list[np.ndarray | None]:
        out: list[np.ndarray | None] = []
        for first in range(0, len(texts), run):
            parts = [words_in(t) for t in texts[first : first + run]]
            every = {w for w in chain.from_iterable(parts) if len(w) <= SHORT}
            fresh = [w for w in every if w not in self.known]
            if len(self.known) + len(fresh) > self.most:
                self.known.clear()
                fresh = list(every)
            if fresh and len(fresh) <= self.most:  # all at once, else text by text
                self.learn(fresh)
            out += [self.text(ws) if ws else None for ws in parts]
        return out


def classify(docs: DataFrame, model: Model, text: str | tuple[str, str] = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or those of ``keep``) with lang_pred and score, the posterior of the predicted language under equal priors. Columns of these names are replaced."""

    def start():
        scorer = Scorer(model)

        def run(texts):
            pred, score = [], []
            for logs in scorer.texts(texts) if model.languages else [None] * len(texts):
                best = None if logs is None else int(np.argmax(logs))
                pred.append(UND if best is None else model.languages[best])
                score.append(0.0 if best is None else float(1 / np.exp(logs - logs[best]).sum()))
            return pa.array(pred, pa.string()), pa.array(score, pa.float64())

        return run

    return common.add_columns(docs, text, "lang_pred string, score double", start, keep)


def held_out(key: str = "doc_id", folds: int = 5):
    """crc32 of the key as text leaves no remainder; a null key is neither held out nor learned from."""
    return F.crc32(F.col(key).cast("string")) % folds == 0


def identify(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row; learns from the rows outside the held-out fold."""
    model = train(docs.filter(~held_out()), path)
    return classify(docs, model, keep=["doc_id"]).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
