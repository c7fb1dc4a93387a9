import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from ledgerwise.llm import lm
from pyspark.sql import functions as F

END = object()


def tokens(t):
    return [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), END]


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2


@pytest.mark.parametrize("known", [1 << 19, 20, 1])
def test_base_score_and_counts(spark, docs, rows, known):
    got = lm.score(docs, lm.split_of("doc_id", 7) == 2, known=known).collect()
    c = Counter(t for r in rows if not held(r[0]) for t in tokens(r[1]))
    n = sum(c.values())
    want = Counter()
    for r in rows:
        t = tokens(r[1])
        want[(r[0], held(r[0]), len(t), sum(c[x] > 0 for x in t), n, round(sum(log10((c[x] + 1) / (n + len(c) + 1)) for x in t), 5))] += 1
    assert Counter((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 5)) for g in got) == want
    again = Counter((g.doc_id, round(g.score, 6)) for g in lm.score(docs.repartition(5), lm.split_of("doc_id", 7) == 2, known=known).collect())
    assert again == Counter((g.doc_id, round(g.score, 6)) for g in got)
    assert sum(g.score for g in got) > sum(g.base_score for g in got)


def test_without_training_rows(spark, docs):
    got = lm.score(docs, F.lit(True)).collect()
    assert all(g.n_known == 0 and g.train_tokens == 0 and g.base_score == g.score == 0 for g in got)
    assert lm.score(docs.limit(0), F.lit(False)).count() == 0


def portion(seed=4, words=6, texts=200):
    """An automaton of random texts, half of them training, with its n-grams counted in dictionaries."""
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 40, texts)
    size[3] = 3 * lm.LANE + 5
    first = np.concatenate([[0], np.cumsum(size)])
    w = rng.integers(1, words + 1, first[-1])
    w[first[1:] - 1] = words + 1  # the end
    w[rng.random(len(w)) < 0.1] = -5  # a token beyond the known ones
    orders = lm._orders(w, first, 3)
    train = np.repeat(np.arange(texts) % 2, size).astype(float)
    got = []
    for g in orders[1:]:
        n = np.bincount(g.place, train[g.where], len(g.w)).astype(np.int64)
        got.append([n, *(np.bincount(g.of, x, len(g.c)).astype(np.int64) for x in (n, n > 0))])
    one = Counter(w[train > 0].tolist())
    p1 = np.array([one[x] + 1 for x in w.tolist()]) / (sum(one.values()) + len(one) + 1)
    return lm.Automaton(first, orders, p1, got), w, p1


def test_states_carried_from_left_to_right():
    """The states of the traversal are those that the last two tokens name, and lanes don't change scores."""
    m, w, _ = portion()
    assert m.before.max() == len(m.fail) - 1 and (m.fail > 0).any() and (m.weight[1:] < 0).all()
    total = []
    for a, z in zip(m.first[:-1], m.first[1:]):
        state, score = m.before[a : a + 1], 0.0
        for i in range(a, z):
            assert state[0] == m.before[i]
            gain, state = m.step(state, np.array([i]))
            score += gain[0]
        total.append(score)
    assert np.allclose(m.scores(), total)


def test_columns_are_packed_without_loss():
    rng = np.random.default_rng(5)
    columns = [rng.integers(-(1 << 63), 1 << 62, 50), np.zeros(7, np.int64), np.zeros(0, np.int64), rng.integers(0, 300, 9), np.array([(1 << 63) - 1, 0])]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(lm._unpacked(lm._packed(*columns)), columns))


def test_failure_arcs_give_the_interpolated_model():
    m, w, p1 = portion(seed=9)

    def p(state, i):
        """By following failure arcs from a state until it has an arc for the token at i."""
        for arc in (m.arc3[i], m.arc2[i]):
            if m.source[arc] == state:
                return m.logp[arc]
        return m.weight[state] + p(m.fail[state], i) if state else np.log10(p1[i])

    want = [sum(p(m.before[i], i) for i in range(a, z)) for a, z in zip(m.first[:-1], m.first[1:])]
    assert np.allclose(m.scores(), want)


@pytest.mark.parametrize("known", [1 << 19, 20])
def test_score_uses_every_pair_and_triple(spark, docs, rows, known):
    """Against a model of all n-grams in dictionaries; most are seen once, and half of the words are rare."""
    got = lm.score(docs, lm.split_of("doc_id", 7) == 2, known=known)
    texts = [tokens(r[1]) for r in rows]
    one, pairs, triples = Counter(), Counter(), Counter()
    for r, t in zip(rows, texts):
        if not held(r[0]):
            one.update(t)
            pairs.update(zip([None, *t], t))
            triples.update(zip([None, *t], t, t[1:]))
    total, d = sum(one.values()) + len(one) + 1, lm.DISCOUNT
    after = {}
    for c, n in [*pairs.items(), *triples.items()]:
        at = after.setdefault(c[:-1], [0, 0])
        at[0] += n
        at[1] += 1

    def p(context, w):
        if not context:
            return (one[w] + 1) / total
        n, kinds = after.get(context, (0, 0))
        lower = p(context[1:], w)
        return (max((triples if len(context) > 1 else pairs)[(*context, w)] - d, 0) + d * kinds * lower) / n if n else lower

    want = Counter()
    for r, t in zip(rows, texts):
        before = [None, *t]
        want[(r[0], round(sum(log10(p(tuple(before[max(0, i - 1) : i + 1]), w)) for i, w in enumerate(t)), 4))] += 1
    assert Counter((g.doc_id, round(g.score, 4)) for g in got.collect()) == want
    assert any(held(r[0]) for r in rows) and min(triples.values()) == 1
