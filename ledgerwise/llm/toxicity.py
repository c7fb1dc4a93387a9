"""Toxic passages as maximum-scoring segments of token log-odds.

Fitting uses at most ``LABELS`` labelled rows, the first by a hash of doc_id. Tokens are words
and their beginnings of 4 to 8 bytes, so inflected and compound forms count too. For each token
the number of toxic and of clean texts that hold it is taken, a family of near copies (texts with
one minimal shingle hash) counting as one text. With an informative Dirichlet prior, the tokens'
shares in both, this gives log-odds. Tokens whose likelihood ratio against equal shares has a
root beyond ``SURE`` carry their log-odds, however many there are; a word carries that of its
strongest token, and every other word costs ``DRIFT``.

A linear scan (Ruzzo and Tompa, 1999) finds all maximal segments of a text. The chance of a
segment of score S among n words is extreme-value distributed: K n exp(-L S) are expected,
where L solves sum(p exp(L s)) = 1 over the scores' clean shares p, and K comes from clean
texts. A logistic curve of the best segment's score and evidence, and of all significant
segments together, makes the score. The curve is fitted on one half of the labelled rows
with words learnt from the other, so neither sees itself.

Defined cases: null and empty texts have no segment and get the curve's floor; a very long text
is scanned whole, its length entering the expected number only; rows of labels with a null are
left out, several labels of a doc_id count as toxic if one does; without toxic or without clean
labels every score is the share of toxic labels; repeated rows are scored each, equal texts alike;
empty tables give empty results. Only doc_id (to find labels) and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._store import stash
from ._words import ALNUM, Words, pieces

LABELS, SURE, DRIFT = 30_000, 4.5, 0.05
E_VALUE = 0.05
BEGINNINGS = range(4, 9)


def segments(at: list[int], score: list[float], drift: float) -> list[tuple[int, int, float]]:
    """(first word, word after the last, score) of all maximal segments; words between those at `at` cost `drift` each."""
    out: list[list[float]] = []  # first, end, sum before, sum through
    total, last = 0.0, -1
    for a, s in zip(at, score):
        total -= drift * (a - last - 1)
        last = a
        before, total = total, total + s
        if s <= 0:
            continue
        here = [a, a + 1, before, total]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= here[2]:
                j -= 1
            if j < 0 or out[j][3] >= here[3]:
                out.append(here)
                break
            here = [out[j][0], here[1], out[j][2], here[3]]
            del out[j:]
    return [(int(a), int(b), r - l) for a, b, l, r in out]


@dataclass
class Model:
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rate: float = 1.0  # L
    k: float = 1.0
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def passages(self, text: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """The number of words of each text and its segments."""
        for i, j, w in pieces(text, ALNUM):
            best = np.full(len(w), -np.inf)
            for word, h in _tokens(w) if len(self.words) else ():
                p = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
                own = np.flatnonzero(self.words[p] == h)
                np.maximum.at(best, word[own], self.scores[p[own]])
            hit = np.flatnonzero(np.isfinite(best))
            cut = np.searchsorted(hit, w.first)
            for d in range(j - i):
                x = hit[cut[d] : cut[d + 1]]
                yield int(w.first[d + 1] - w.first[d]), segments((x - w.first[d]).tolist(), best[x].tolist(), DRIFT) if len(x) else []

    def features(self, n: int, found: list[tuple[int, int, float]]) -> list[float]:
        if not found:
            return [1.0, 0.0, 0.0, 0.0]
        best = self.rate * max(s for *_, s in found)
        each = [self.rate * s - log(self.k * max(n, 1)) for *_, s in found]
        return [1.0, best / 10, max(each) / 10, sum(e for e in each if e > -log(E_VALUE)) / 20]

    def score(self, text: pa.Array) -> np.ndarray:
        x = np.array([self.features(n, s) for n, s in self.passages(text)]).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))


def _tokens(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, hashes) of the words themselves and of each length of their beginnings."""
    yield np.arange(len(w)), w.hash
    for n in BEGINNINGS:
        word, h = w.beginnings(n)
        yield word, h


def _family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) batches with the family of each text."""
    for b in batches:
        family = []
        for i, j, w in pieces(b.column(1), ALNUM):
            p, h = w.shingles(3)
            cut = np.searchsorted(p, w.first)
            for d in range(j - i):
                low = h[cut[d] : cut[d + 1]]
                low = low if len(low) else w.hash[w.first[d] : w.first[d + 1]]
                family.append(int(low.min().view(np.int64)) if len(low) else 0)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(family, pa.int64())], names=["toxic", "text", "family"])


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, weight, text) batches to the weight of the toxic and of the clean texts that hold each token."""
    for b in batches:
        toxic, weight = b.column(0).to_numpy() == 1, b.column(1).to_numpy()
        of, hs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for i, _, w in pieces(b.column(2), ALNUM):
            text = w.text_of()
            for word, h in _tokens(w):
                order = np.lexsort((h, text[word]))
                t, h = text[word][order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
                of.append(t[new] + i)
                hs.append(h[new])
        of, (h, at) = np.concatenate(of), np.unique(np.concatenate(hs), return_inverse=True)
        sums = [np.bincount(at, weight[of] * (toxic[of] == k), len(h)) for k in (True, False)]
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(sums[0]), pa.array(sums[1])], names=["h", "t", "c"])


def _lexicon(seen: DataFrame) -> Model:
    """seen: toxic, weight, text. Log-odds of tokens with a Dirichlet prior of their overall shares."""
    each = seen.select("toxic", "weight", "text").mapInArrow(_presence, "h bigint, t double, c double").groupBy("h").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    each = stash(each, "words")
    nt, nc = each.agg(F.coalesce(F.sum("t"), F.lit(0.0)), F.coalesce(F.sum("c"), F.lit(0.0))).first()
    if not nt or not nc:
        return Model()

    part = lambda y, n: F.when(F.col(y) > 0, F.col(y) * F.log(F.col(y) * (nt + nc) / (n * (F.col("t") + F.col("c"))))).otherwise(0.0)
    each = each.withColumn("z", F.sqrt(F.greatest(F.lit(0.0), 2 * (part("t", nt) + part("c", nc)))))
    each = each.where(F.col("z") >= SURE)
    prior = min(nt, nc) / 2
    each = each.withColumn("a", (F.col("t") + F.col("c")) * (prior / (nt + nc)))
    odds = lambda y, n: F.log((F.col(y) + F.col("a")) / (n + prior - F.col(y) - F.col("a")))
    each = each.withColumn("d", odds("t", nt) - odds("c", nc))
    rows = each.select("h", "d", ((F.col("c") + F.col("a")) / (nc + prior)).alias("p")).collect()  # sure words of LABELS texts at most
    rows = sorted(rows, key=lambda r: r.h % (1 << 64))
    m = Model(np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.d for r in rows]))
    p, s = np.append([r.p for r in rows], 0.0), np.append(m.scores, -DRIFT)
    p[-1] = max(0.0, 1 - p.sum())
    if (m.scores > 0).any():
        low, high = 1e-6, 1.0
        while (p * np.exp(high * s)).sum() < 1 and high < 50:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if (p * np.exp(mid * s)).sum() > 1 else (mid, high)
        m.rate = high
    return m


def _measured(model):
    """(toxic, weight, text) batches to words, and scores of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(model.value.passages(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([n for n, _ in got], pa.int64()), pa.array([[s for *_, s in f] for _, f in got], pa.list_(pa.float64()))], names=["toxic", "weight", "n", "found"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; features that would count against toxicity are left out."""
    on = np.arange(x.shape[1])
    while True:
        b = np.zeros(x.shape[1])
        b[on] = _newton(x[:, on], y, w)
        if (b[1:] >= 0).all():
            return b
        on = on[(on == 0) | (b[on] >= 0)]


def _newton(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    b, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [0.02] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELS) -> Model:
    """A model of docs (doc_id, text) and labels (doc_id, toxic)."""
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("_d")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("_d"), "_d").limit(bound)  # so it can be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_d"))
    texts = stash(texts.select("toxic", "text").mapInArrow(_family, "toxic int, text string, family bigint"), "labelled")
    sizes = texts.groupBy("family", "toxic").agg((1.0 / F.count("*")).alias("weight"))  # `bound` rows at most
    half = F.pmod(F.xxhash64("family", F.lit("half")), F.lit(2)).alias("half")
    seen = stash(texts.join(F.broadcast(sizes), ["family", "toxic"]).select("toxic", "weight", "text", half), "weighted")
    total, bad = seen.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not bad or bad == total:
        share = min(max(bad / total if total else 0.0, 1e-6), 1 - 1e-6)
        return Model(curve=np.array([log(share / (1 - share)), 0, 0, 0]))
    rows, halves = [], []
    for half in (0, 1):
        m = _lexicon(seen.where(F.col("half") == half))
        other = seen.where(F.col("half") != half).select("toxic", "weight", "text")
        got = other.mapInArrow(_measured(spark.sparkContext.broadcast(m)), "toxic int, weight double, n bigint, found array<double>").collect()  # `bound` rows at most
        clean = [r for r in got if not r.toxic]
        low = m.scores[m.scores > 0].min(initial=1.0) if (m.scores > 0).any() else 1.0
        m.k = (1 + sum(bool(r.found) for r in clean)) / (1 + sum(r.n for r in clean)) * exp(min(30, m.rate * low))
        halves.append(m)
        rows += [(m.features(r.n, [(0, 0, s) for s in r.found]), r.toxic, r.weight) for r in got]
    final = _lexicon(seen)
    final.k = float(np.mean([m.k for m in halves]))
    final.curve = _logistic(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows]))
    return final


def scorer(spark, model: Model):
    """A column function: text to score."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(pa.array(text, pa.string())))

    return score


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, word range, score and expected number of each significant passage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = []
            for d, (n, found) in zip(b.column(0).to_pylist(), m.passages(b.column(1))):
                for a, z, s in found:
                    e = m.k * n * exp(-m.rate * s)
                    if e < E_VALUE:
                        out.append((d, a, z, s, e))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=["doc_id", "first_word", "end_word", "score", "expected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, first_word bigint, end_word bigint, score double, expected double")
