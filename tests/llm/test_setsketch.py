import random
import re

import numpy as np
from ledgerwise.llm import setsketch as S


def shingle_set(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def components(rows, sets, percent=85):
    """The number of each row's component."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def brute(rows):
    """rows: (doc_id, text) with None sorting last."""
    key = lambda d: S.NULL_ID if d is None else d
    sets = [shingle_set(t) for _, t in rows]
    comps, out = components(rows, sets), []
    for i, (d, _) in enumerate(rows):
        low = min(key(rows[j][0]) for j in range(len(rows)) if comps[j] == comps[i])
        out.append((d, len(sets[i]), None if low == S.NULL_ID else low, key(d) == low))
    return sorted(out, key=str)


def one_each(rows):
    """The (doc_id, text) that stay: one of each component, and all without words; of a component's smallest ids any text may stay."""
    sets, out, done = [shingle_set(t) for _, t in rows], [], set()
    comps = components(rows, sets)
    for i, (d, t) in enumerate(rows):
        if not sets[i]:
            out.append((d, t))
        elif comps[i] not in done:
            done.add(comps[i])
            low = min((rows[j] for j in range(len(rows)) if comps[j] == comps[i]), key=lambda r: S.NULL_ID if r[0] is None else r[0])
            out.append(low)
    return sorted(out, key=str)


def same(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in S.near_duplicates(df).collect()]
    assert sorted(got, key=str) == brute(rows)
    left = [(r.doc_id, r.text) for r in S.keep_one(df).collect()]
    assert sorted(left, key=str) == one_each(rows)


def edited(r, words, share):
    return [r.choice(words) + "x" if r.random() < share else w for w in words]


def test_matches_brute_force(spark, rows):
    same(spark, [(r[0], r[1]) for r in rows])


def test_chains_and_families(spark):
    """Groups whose members link through others, and members near the threshold."""
    r = random.Random(5)
    rows, n = [], 0
    for _ in range(5):
        words = [f"v{r.randint(0, 5000)}" for _ in range(300)]
        for step in range(8):
            rows.append((n, " ".join(words)))
            n += r.randint(1, 3)
            words = edited(r, words, 0.02 if step % 3 else 0.04)
    base = [f"u{r.randint(0, 5000)}" for _ in range(200)]
    rows += [(n + i, " ".join(edited(r, base, 0.015))) for i in range(40)]
    same(spark, [(1000 - a, t) for a, t in rows])


def test_keep_one_with_clashing_columns(spark, rows):
    text = rows[8][1]
    data = [(r[0], r[1], "a", "b", 1, 2) for r in rows] + [(8, text, "a", "b", 1, 2)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, _d string, _text string, id int, n int").repartition(2)
    left = S.keep_one(df)
    assert left.columns == df.columns
    want = {d for d, _, _, keep in brute([(r[0], r[1]) for r in data]) if keep}
    got = [r.doc_id for r in left.collect()]
    assert set(got) == want and len(got) == len(set(got))


def test_empty(spark):
    same(spark, [])
    same(spark, [(1, None), (2, ""), (3, " "), (3, " ")])


def test_null_and_repeated_ids_on_other_texts(spark):
    """Ids that are null or repeat name several texts; only a text's own copies go with it."""
    r = random.Random(8)
    a, b, c, d = (" ".join(f"{x}{r.randint(0, 900)}" for _ in range(60)) for x in "abcd")
    same(spark, [(None, a), (None, c), (3, a + " zzz"), (5, b), (5, d), (4, b + " end"), (None, b + " more"), (5, d + " last"), (None, c + " x"), (7, None), (7, ""), (None, None)])


def test_recall_near_the_threshold(spark):
    """Thousands of pairs between 0.78 and 0.92: every link of the brute force is found, and no other."""
    r = random.Random(21)
    rows, want = [], set()
    for g in range(1500):
        words = [f"w{g}_{i}" for i in range(r.randint(60, 120))]
        x = list(words)
        for at in r.sample(range(2, len(x) - 2), r.randint(1, 3)):
            x[at] += "_"
        y = words + [f"tail{g}_{i}" for i in range(r.randint(0, 24))]
        rows += [(3 * g, " ".join(words)), (3 * g + 1, " ".join(x)), (3 * g + 2, " ".join(y))]
        sets = [shingle_set(t) for _, t in rows[-3:]]
        for i, j in ((0, 1), (0, 2), (1, 2)):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                want.add((3 * g + i, 3 * g + j))
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in sorted(want):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    got = {x.doc_id: x.component_id for x in S.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(want) > 2000 and got == {d: find(d) for d, _ in rows}


def test_large_group_in_small_blocks(spark, monkeypatch):
    """A bucket of many components is dealt in several blocks and still gives the links of the brute force."""
    r = random.Random(4)
    base = [f"u{i}" for i in range(220)]
    rows = [(i, " ".join(edited(r, base, 0.03))) for i in range(150)]
    monkeypatch.setattr(S, "BLOCK", 16)
    same(spark, rows)


def test_estimates_follow_similarity():
    rng = np.random.default_rng(3)
    err = []
    for share in (0.2, 0.6, 0.85, 0.95):
        for _ in range(30):
            n = 600
            common = int(round(2 * n * share / (1 + share)))
            a = rng.integers(0, 2**64, n, dtype=np.uint64)
            b = np.concatenate([a[:common], rng.integers(0, 2**64, n - common, dtype=np.uint64)])
            s, t = S.registers(a), S.registers(b)
            one = lambda x: np.array([float(x)])
            err.append(S.likeliest(one((s == t).sum()), one((s > t).sum()), one((s < t).sum()), one(n), one(n))[0] - share)
    assert abs(np.mean(err)) < 0.01 and np.std(err) < 0.035
    merged = S.registers(np.concatenate([a, b]))
    assert (merged == np.maximum(s, t)).all()
