"""The registered queries on a small table of nulls, blanks, repeats, ties, copies and a long text, against brute force."""

import hashlib
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
import xxhash
from conftest import DOCS, made
from ledgerwise.llm import lm, media, queries, ring
from ledgerwise.llm.tokens import default_vocabulary
from test_decontam import brute as contamination
from test_lm import held, tokens
from test_media_pii_html import PAGE
from test_media_pii_html import brute as base_spans
from tokenizers import Tokenizer

QUERIES = queries.queries()
PAGES = [(1, "u", PAGE % "<article><p>Only this, once.</p><p>And this, too.</p></article>", "clash"), (2, None, None, "c"), (2, None, None, "c"), (3, "v", "", "c"), (None, "w", "<p>" + "many words, " * 3000 + "</p>", "c")]
SCHEMAS = {
    "documents": DOCS + ", contaminated boolean, slot int, spans string",
    "labels": "doc_id bigint, quality int, toxic int, score double",
    "benchmark": "item_id bigint, text string, items string",
    "pages": "page_id bigint, url string, html string, text string",
}


def written(spark, at, tables):
    for name, rows in tables.items():
        spark.createDataFrame(rows, SCHEMAS[name]).repartition(2).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    long = rows[66][1].split()
    bench = [(1, rows[67][1], "x"), (2, "one", None), (3, None, None), (None, "null id text here", "y"), (4, " ".join(long[40:80]), "z"), (4, " ".join(long[40:80]), "z")]
    labels = [(i, 1, int(i % 5 == 0), 0.5) for i in range(0, 60)] + [(None, 0, 1, None), (3, None, None, None), (5, 1, 0, 0.1)]
    return written(spark, tmp_path_factory.mktemp("sf"), {"documents": [(*r, None, 1, "s") for r in rows], "labels": labels, "benchmark": bench, "pages": PAGES})


def got(spark, sf, name):
    return QUERIES[next(n for n in QUERIES if n.startswith(f"{name}_"))](spark, sf).collect()


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def test_op1(spark, sf, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = Counter((d, n, h, len(ids), sha(",".join(ids)), c) for d, n, h, ids, c in contamination([(r[0], r[1]) for r in rows], items))
    assert Counter((g.doc_id, g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) for g in got(spark, sf, "op1")) == want


def test_op2(spark, sf):
    want = Counter([(1, "u", "Only this, once.\nAnd this, too."), (2, None, ""), (2, None, ""), (3, "v", ""), (None, "w", ("many words, " * 3000).strip())])
    rows = got(spark, sf, "op2")
    assert Counter((g.page_id, g.url, g.text) for g in rows) == want and all(g.n_chars == len(g.text) for g in rows)


def test_op3(spark, sf, rows):
    """All columns, the score against a model of dictionaries."""
    texts = [tokens(r[1]) for r in rows]
    one, pairs, triples = Counter(), Counter(), Counter()
    for r, t in zip(rows, texts):
        if not held(r[0]):
            one.update(t)
            pairs.update(zip([None, *t], t))
            triples.update(zip([None, *t], t, t[1:]))
    n, d = sum(one.values()), lm.DISCOUNT
    after = {}
    for c, k in [*pairs.items(), *triples.items()]:
        at = after.setdefault(c[:-1], [0, 0])
        at[0] += k
        at[1] += 1

    def p(context, w):
        if not context:
            return (one[w] + 1) / (n + len(one) + 1)
        total, kinds = after.get(context, (0, 0))
        lower = p(context[1:], w)
        return (max((triples if len(context) > 1 else pairs)[(*context, w)] - d, 0) + d * kinds * lower) / total if total else lower

    want = Counter()
    for r, t in zip(rows, texts):
        before = [None, *t]
        base, score = sum(log10(p((), w)) for w in t), sum(log10(p(tuple(before[max(0, i - 1) : i + 1]), w)) for i, w in enumerate(t))
        want[(r[0], held(r[0]), len(t), sum(one[w] > 0 for w in t), n, round(base, 4), round(score, 4))] += 1
    assert Counter((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 4), round(g.score, 4)) for g in got(spark, sf, "op3")) == want


def sign_feature(data):
    """The feature from its definition: area averages to 32 x 32, then the 64 lowest cosine coefficients against their median."""
    image = np.frombuffer(data, np.uint8).reshape(-1, 64).astype(float)

    def shares(x):
        """Each of 32 equal shares of the rows averaged, with parts of rows counted by their size."""
        edge = np.linspace(0, len(x), 33)
        weight = np.clip(np.minimum(edge[1:, None], np.arange(1, len(x) + 1)) - np.maximum(edge[:-1, None], np.arange(len(x))), 0, None)
        return weight @ x / weight.sum(1, keepdims=True)

    small = shares(shares(image).T).T
    k, x = np.arange(8)[:, None], np.arange(32)[None, :]
    cos = np.cos(np.pi / 32 * (x + 0.5) * k)
    low = np.round(cos @ small @ cos.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def test_op4(spark, sf, rows):
    want = Counter()
    for r in rows:
        t = (r[1] or "").encode()
        data = t + bytes(64 - len(t) % 64 if len(t) % 64 or not t else 0)
        png = media.write_png(data)
        want[(r[0], len(t), len(data), sha(data), zlib.crc32(data[-64:]), len(png), sha(png), sign_feature(data))] += 1
    assert Counter(tuple(g) for g in got(spark, sf, "op4")) == want


def test_op5(spark, sf, rows):
    first = got(spark, sf, "op5")
    want = Counter((r[0], zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 1) for r in rows)
    assert Counter((g.doc_id, g.held_out) for g in first) == want
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.7) for g in first)
    by = {}
    for g, t in [(g, r[1] or "") for g in first for r in rows if r[0] == g.doc_id]:
        by.setdefault(t, set()).add(g.score)
    assert all(len(s) == 1 for t, s in by.items() if t)


def test_op6(spark, sf, rows):
    """Against the ring walked key by key."""
    keys = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    nodes = sorted((xxhash.xxh64_intdigest(f"shard {s} node {p}") - (1 << 63), s) for s in range(24) for p in range(ring.POINTS))
    df = spark.createDataFrame(list(keys), "doc_id bigint, size bigint, crc bigint").selectExpr("*", "xxhash64(doc_id) AS position")
    at = {}
    for r in df.collect():
        arc = next((i for i, (p, _) in enumerate(nodes) if p >= r.position), 0)
        at.setdefault(arc, []).append((r.position, -1 << 63 if r.doc_id is None else r.doc_id, r.size, r.crc))
    n = len(rows)
    room, used, want, over = [n // 24 + (s < n % 24) for s in range(24)], [0] * 24, [], []
    for arc in range(len(nodes)):
        for k in sorted(at.get(arc, [])):
            for _ in range(keys[(None if k[1] == -1 << 63 else k[1], k[2], k[3])]):
                s = nodes[arc][1]
                if used[s] < room[s]:
                    want.append((k[1:], s))
                    used[s] += 1
                else:
                    over.append((arc, k[1:]))
    for arc, k in over:
        while used[nodes[arc][1]] >= room[nodes[arc][1]]:
            arc = (arc + 1) % len(nodes)
        used[nodes[arc][1]] += 1
        want.append((k, nodes[arc][1]))
    have = got(spark, sf, "op6")
    assert Counter(((-1 << 63 if g.doc_id is None else g.doc_id, g.size, g.text_crc32), g.shard) for g in have) == Counter(want)
    assert {(g.law, g.grown_shard) for g in have} == {("rows", None)}
    for s in range(24):
        assert sorted(g.slot for g in have if g.shard == s) == list(range(used[s]))


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(default_vocabulary())
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_op7(spark, sf, rows, ids):
    want = Counter()
    for r in rows:
        x = ids(r[1])
        want.update((r[0], k, a, len(x[a : a + 4096]), zlib.crc32(x[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(x), 4096)))
    have, by = got(spark, sf, "op7"), {}
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in have) == want
    for g in have:
        by.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for places in by.values():
        ends = np.cumsum([0, *(n for _, n in sorted(places))])
        assert [o for o, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= 4096
    assert len(by) <= -(-sum(g.length for g in have) // 4096) + 1


def test_op9(spark, sf, rows):
    kinds = ("email", "ip", "card", "phone")
    want = Counter()
    for r in rows:
        s = base_spans(r[1] or "")
        want[(r[0], *(sum(k == x for k, *_ in s) for x in kinds), sha(",".join(f"{k}:{a}:{b}" for k, a, b in s)))] += 1
    have = got(spark, sf, "op9")
    assert Counter((g.doc_id, g.n_email, g.n_ip, g.n_card, g.n_phone, g.base_sha256) for g in have) == want
    for g in have:
        all_ = [x for x in g.spans.split(",") if x]
        assert sha(",".join(all_[: g.n_email + g.n_ip + g.n_card + g.n_phone])) == g.base_sha256 and len(all_) == g.n_spans


def test_op10(spark, sf, rows, ids):
    have, at = sorted(got(spark, sf, "op10"), key=lambda g: g.start), 0
    for g in have:
        assert g.start == at
        at += g.n_tokens
    order = [-1 if g.doc_id is None else g.doc_id for g in have]
    assert order == sorted(order)
    assert Counter((g.doc_id, g.n_tokens, g.ids_crc32) for g in have) == Counter((r[0], len(ids(r[1])), zlib.crc32(ids(r[1]).tobytes())) for r in rows)


def test_empty_tables(spark, tmp_path):
    at = written(spark, tmp_path, dict.fromkeys(SCHEMAS, []))
    for name, query in QUERIES.items():
        assert query(spark, at).count() == 0, name
