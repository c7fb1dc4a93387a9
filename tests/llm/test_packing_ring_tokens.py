import io
import zlib
from collections import Counter

import numpy as np
import pytest
from ledgerwise.llm import packing, ring, tokenfile
from ledgerwise.llm.tokens import Encoder, default_vocabulary
from tokenizers import Tokenizer

ODD = ["<|endoftext|> a<|startoftext|>b don't we've I'LL", "İ ΑΣ Σ. é x\x1cy \x85 z é 12 3 ́a ß ſt ŉ", "naïve+Été=42%", "\x00\x7f", "x" * 5000]


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(default_vocabulary())
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_cached_ids_equal_the_library(ids, rows):
    e = Encoder(default_vocabulary())
    for text in [r[1] for r in rows] + ODD:
        assert e.ids((text or "").encode()).tolist() == ids(text).tolist()


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
def test_bits_round_trip(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint32)
    raw = tokenfile.pack(x, bits)
    assert len(raw) == 1024 * bits // 8
    assert tokenfile.unpack(raw, 1000, bits).tolist() == x.tolist()


def test_file_random_access(tmp_path):
    rng = np.random.default_rng(1)
    docs = [(i if i % 5 else None, rng.integers(0, 49408, n, dtype=np.uint32)) for i, n in enumerate([1, 70_000, 3, 200_000, 65_536, 1])]
    out = io.BytesIO()
    w = tokenfile.Writer(out, 16)
    for d, x in docs:
        w.add(d, x)
    w.close()
    from pyarrow import BufferReader

    r = tokenfile.Reader(BufferReader(out.getvalue()))
    flat = np.concatenate([x for _, x in docs])
    assert [None if n else int(d) for d, n in zip(r.docs, r.null)] == [d for d, _ in docs]
    for a, b in [(0, 1), (0, len(flat)), (65_535, 65_537), (70_000, 70_004), (131_072, 131_072), (270_005, 300_000)]:
        assert r.ids(a, b).tolist() == flat[a:b].tolist()


def test_token_files(spark, docs, rows, ids):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.read_tokens(spark, *tokenfile.write_tokens(docs)).collect())
    at, order = 0, []
    for start, d, n, _ in got:
        assert start == at
        at += n
        order.append(-1 if d is None else d)
    assert order == sorted(order)
    want = Counter((r[0], len(ids(r[1])), zlib.crc32(ids(r[1]).tobytes())) for r in rows)
    assert Counter(g[1:] for g in got) == want
    assert tokenfile.read_tokens(spark, *tokenfile.write_tokens(docs.limit(0))).count() == 0


def test_packing(spark, docs, rows, ids):
    got = packing.pack(docs, length=256).collect()
    want = Counter()
    for r in rows:
        x = ids(r[1])
        want.update((r[0], k, a, len(x[a : a + 256]), zlib.crc32(x[a : a + 256].tobytes())) for k, a in enumerate(range(0, len(x), 256)))
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    by = {}
    for g in got:
        by.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 256
    assert len(by) <= 1.05 * sum(g.length for g in got) / 256 + 2
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sizes,opens", [(range(1, 21), False), ((2, 3, 7, 11), True), (range(1, 8), True)])
def test_sum_of_squares_follows_its_rule(sizes, opens):
    """Against a direct search for the smallest sum of squares, opening included, while what is open has no room for the rest."""
    rng = np.random.default_rng(2)
    lengths = rng.choice(list(sizes), 400)
    where, place = packing.sum_of_squares(lengths, 20)
    free, best, left, opened = {}, lambda c: sum(n * n for g, n in c.items() if g), int(lengths.sum()), 0
    for i in np.argsort(-lengths, kind="stable"):
        s, q = int(lengths[i]), int(where[i])
        old = Counter(free.values())
        fits = {g for g in free.values() if g >= s}
        after = lambda g: best(old - Counter([g]) + Counter([g - s]))  # noqa: E731, B023
        new = best(old + Counter([20 - s]))
        if not fits or left > sum(free.values()) and new < min(map(after, fits)):
            assert q not in free
            opened += bool(fits)
        else:
            assert after(free[q]) == min(map(after, fits))
        assert place[i] == 20 - free.get(q, 20)
        free[q] = free.get(q, 20) - s
        left -= s
    assert bool(opened) == opens and len(free) <= 1.04 * lengths.sum() / 20 + 1


def test_ring(spark, docs, rows):
    for shards in (4, 24):
        got = ring.assign(docs, shards).collect()
        assert Counter((g.doc_id, g.size, g.text_crc32) for g in got) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
        slots = {}
        for g in got:
            slots.setdefault(g.shard, []).append(g.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        sizes = [len(slots.get(s, [])) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1
    assert ring.assign(docs.limit(0)).count() == 0


def test_ring_hot_key_and_movement(spark):
    hot = spark.createDataFrame([(1, "same")] * 500 + [(i, f"t{i}") for i in range(1000)], "doc_id bigint, text string")
    got = ring.assign(hot, 24).collect()
    count = Counter(g.shard for g in got)
    assert len(got) == 1500 and max(count.values()) - min(count.values()) <= 1
    ids = spark.range(4000).selectExpr("id as doc_id", "'x' as text")
    home = lambda n: {g.doc_id: g.shard for g in ring.assign(ids, n).collect()}
    a, b = home(24), home(25)
    assert sum(a[d] != b[d] for d in a) < 0.1 * len(a)  # a 25th of them must
