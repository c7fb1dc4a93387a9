import random

import numpy as np
import pyarrow as pa
from ledgerwise.llm import toxicity as T


def test_segments_against_all_intervals():
    """Ruzzo and Tompa: the best interval, then the best of what lies left and right of it."""
    r = random.Random(1)

    def brute(s, a, b):
        best = max(((sum(s[i:j]), -(j - i), -i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = -best[2], best[3]
        return brute(s, a, i) + [(i, j, best[0])] + brute(s, j, b)

    for _ in range(200):
        n = r.randint(1, 30)
        at = sorted(r.sample(range(n), r.randint(0, n)))
        score = [r.choice([-2.13, -1.07, 1.03, 2.11, 3.19]) for _ in at]
        full = [-0.31] * n
        for i, x in zip(at, score):
            full[i] = x
        got = T.segments(at, score, 0.31)
        want = brute(full, 0, n)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def corpus(n=600, seed=3):
    r = random.Random(seed)
    vocab = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(5, 120))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(r.randint(2, 5)):
                words.insert(r.randrange(len(words)), r.choice(["vilest!", "Grotty", "grottyness", "mucklike"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    extra = [(9000, None), (9001, ""), (9002, "vilest vilest Vilest"), (None, "word1 word2"), (9003, rows[0][1]), (9003, rows[0][1])]
    docs = spark.createDataFrame([(*x, "clash") for x in rows + extra], "doc_id bigint, text string, toxic string").repartition(3)
    table = spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1), (5, None), (7, 1), (7, 0)], "doc_id bigint, toxic int")
    model = T.fit(docs, table)
    got = {(r.doc_id, r.text): r.s for r in docs.select("doc_id", "text", T.scorer(spark, model)("text").alias("s")).collect()}
    assert len(got) == len(rows) + len(extra) - 1 and all(0 <= s <= 1 for s in got.values())
    held = [x for x in labels if x[0] % 3 == 0]
    right = sum((got[i, rows[i][1]] >= 0.7) == bool(t) for i, t in held)
    assert right >= 0.97 * len(held)
    assert got[9000, None] == got[9001, ""] < 0.3 and got[9002, "vilest vilest Vilest"] >= 0.7
    found = T.passages(docs.where("doc_id >= 9000"), model).collect()
    assert {(f.doc_id, f.first_word, f.end_word) for f in found if f.doc_id == 9002} == {(9002, 0, 3)}


def test_one_sided_labels(spark):
    rows, labels = corpus(30)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for keep in ([x for x in labels if x[1]], [x for x in labels if not x[1]], []):
        m = T.fit(docs, spark.createDataFrame(keep, "doc_id bigint, toxic int"))
        s = m.score(pa.array(["word1", None]))
        assert np.allclose(s, 1 if keep and keep[0][1] else 0, atol=1e-3)
