"""Near-duplicate groups with SetSketch registers (Ertl, 2021).

A document's set is its distinct ``K``-word shingles. A sketch has ``M`` registers; each
is the minimum of exponentially distributed hashes of the shingles, on a logarithmic scale
of base ``BASE`` and truncated to a fixed range. Minima merge, so a sketch of a union is
the larger of two registers, and equal registers say how much two sets share.

1. One pass reads the documents: set size, a 128-bit key of the set, the sketch. Rows of
   equal sets form a class, a node with a number of its own; doc_ids enter only at the end.
2. Runs of ``ROWS`` registers are bands. Classes that agree on a band share a bucket. Each
   is paired with the bucket's smallest member only, so a bucket of n makes n - 1 pairs.
3. Pairs whose sizes forbid the similarity, or whose joint likelihood over the registers puts
   it five standard errors below, go; the rest are confirmed on their full sets.
4. Confirmed links make components. Where a bucket's members are still in several, those not
   yet compared are confirmed block by block, so no link is lost to the choice in 2; blocks
   are bounded in rows and bytes, return at most a spanning forest, and skip what is connected
   already. Of buckets with the same members one is looked at.

A pair of similarity s shares no band with probability (1 - s**6)**42: 2e-9 at 0.85, 3e-6 at 0.8.

Defined cases: texts without words have the empty set and link with nothing, each row for
itself; texts of fewer than ``K`` words have one shingle; null doc_ids sort last and come back
as null, where they are kept if their component has no other id; rows are told apart by text,
so a doc_id that repeats, or is null, on other texts joins nothing (2**63 - 1 is read as null); repeated rows link; ties go
to the smallest doc_id, then to a hash of the text; a very long text is one set of 8 bytes a
shingle; empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._store import release, stash
from ._words import SLICE, SPACED, mix, pieces, portions

K, PERCENT = 3, 85
M, ROWS, BASE, RATE, TOP = 252, 6, 1.02, 20.0, 4094
BLOCK, BLOCK_BYTES = 1024, 32 << 20
NULL_ID = (1 << 63) - 1

_rng = np.random.Generator(np.random.PCG64(20210))
_XOR = _rng.integers(0, 1 << 32, M, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, M, dtype=np.uint32) | np.uint32(1)


def _sets(text: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for i, j, w in pieces(text, SPACED):
        count = np.diff(w.first)
        found = []
        for s in range(1, k + 1):  # fewer words than k: the whole sequence
            p, h = w.shingles(s)
            doc = w.text_of()[p]
            keep = slice(None) if s == k else count[doc] == s
            found.append((doc[keep], h[keep]))
        doc, h = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        doc, h = doc[new], h[new]
        at = np.searchsorted(doc, np.arange(j - i + 1))
        for d in range(j - i):
            yield h[at[d] : at[d + 1]]


def registers(h: np.ndarray) -> np.ndarray:
    """The M registers of a set of shingle hashes."""
    low = np.full(M, 0xFFFFFFFF, np.uint32)
    x = (h >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, ((x[i : i + 2048, None] ^ _XOR) * _MUL).min(axis=0), out=low)
    least = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, one, two, sketch = [], [], [], []
            for h in _sets(b.column(0), k):
                n.append(len(h))
                one.append(int(mix(h + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) if len(h) else 0)
                two.append(int(mix(h ^ np.uint64(0x5DEECE66D5DEECE6)).sum(dtype=np.uint64).view(np.int64)) if len(h) else 0)
                sketch.append(registers(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sketch, pa.binary())], names=[*b.schema.names[1:], "n", "k1", "k2", "sketch"])

    return run


def likeliest(equal: np.ndarray, more: np.ndarray, less: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """The similarity that maximises the joint likelihood of the registers of two sets of n1 and n2 elements."""
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    share = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)[:, None]
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u[:, None] - v[:, None] * share), p(v[:, None] - u[:, None] * share)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    best = np.argmax(more[:, None] * log(up) + less[:, None] * log(down) + equal[:, None] * log(1 - up - down), axis=1)
    return share[np.arange(len(share)), best]


def _least(percent: int) -> float:
    s = percent / 100
    return s - 5 * (s * (1 - s) / M) ** 0.5


def _maybe(s: np.ndarray, t: np.ndarray, n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    """Whether the likeliest similarity of sketches s and t may be enough; few equal registers settle it without the likelihood."""
    least, equal = _least(percent), (s == t).sum(1)
    out = equal >= M * (least - 0.1)
    i = np.flatnonzero(out)
    if len(i):
        a, b = np.broadcast_to(s, t.shape)[i], t[i]
        out[i] = likeliest(equal[i], (a > b).sum(1), (a < b).sum(1), n1[i], n2[i]) >= least
    return out


def _plausible(percent: int):
    """(a, b, sizes, sketches) batches to the pairs (a, b) that may be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n1, n2 = b.column(2).to_numpy().astype(float), b.column(3).to_numpy().astype(float)
            s, t = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, M) for c in (4, 5))
            keep = _maybe(s, t, n1, n2, percent)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], names=["a", "b"])

    return run


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _as_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([_similar(_as_set(x.as_buffer()), _as_set(y.as_buffer()), percent) for x, y in zip(b.column(2), b.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return run


def _full_sets(k: int):
    """(node, text) batches to the set of each node; a node's texts have equal sets, so a task gives it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            new = [i for i, x in enumerate(b.column(0).to_pylist()) if x not in seen and not seen.add(x)]
            b = b.take(pa.array(new, pa.int64()))
            for p in portions(b, 1, SLICE):
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array([h.astype("<u8").tobytes() for h in _sets(p.column(1), k)], pa.binary())], names=["node", "shingles"])

    return run


def _block_links(percent: int):
    """Rows of blocks, sorted by (bucket, lo, hi), to links between different components inside each block pair."""

    def links(rows: list[dict], lo: int, hi: int) -> Iterator[tuple[int, int]]:
        root = {r["comp"]: r["comp"] for r in rows}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        n = np.array([r["n"] for r in rows], float)
        sk = np.frombuffer(b"".join(r["sketch"] for r in rows), "<u2").reshape(-1, M)
        block, comp, hub = (np.array([r[c] for r in rows]) for c in ("block", "comp", "is_hub"))
        bands = sk.view(f"V{2 * ROWS}")  # each band as one value
        band = rows[0]["band"]
        sets = [_as_set(r["shingles"]) for r in rows]
        for i in range(len(rows)):
            js = np.flatnonzero((comp != comp[i]) & ~hub & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            js = js[(js > i) & (((block[i] == lo) & (block[js] == hi)) | ((block[i] == hi) & (block[js] == lo)))]
            if hub[i] or not len(js):
                continue
            if band:  # in the first bucket that they share only
                js = js[~(bands[js, :band] == bands[i, :band]).any(1)]
            js = js[_maybe(sk[i][None, :], sk[js], np.full(len(js), n[i]), n[js], percent)]
            for j in js.tolist():
                x, y = find(rows[i]["comp"]), find(rows[j]["comp"])
                if x != y and _similar(sets[i], sets[j], percent):
                    root[max(x, y)] = min(x, y)
                    yield rows[i]["node"], rows[j]["node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, out = [], None, []
        for b in batches:
            for r in b.to_pylist():
                if (key := (r["bucket"], r["lo"], r["hi"])) != at:
                    if held:
                        out += links(held, at[1], at[2])
                    held, at = [], key
                held.append(r)
        if held:
            out += links(held, at[1], at[2])
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (id, comp): the smallest id of each linked id's component.

    Alternating large-star and small-star rounds; each is a partial minimum and a join, and
    its result is written, until the stars stop changing. Minima are written too, so that a join
    on a large star's centre is one that adaptive execution can split, or broadcasts where small.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    stars = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    was = None
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == was or not now[0]:
            return stars.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())
        was = now
        near = both(stars)
        low = stash(near.groupBy("a").agg(F.least("a", F.min("b")).alias("low")), "low")
        large = stash(near.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b").distinct(), "large")
        release(low)
        low = stash(large.groupBy("a").agg(F.min("b").alias("low")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b").unionByName(low.select("a", F.col("low").alias("b")))
        old, stars = stars, stash(small.distinct(), "stars")
        release(old, low, large)


def _near(df: DataFrame) -> DataFrame:
    """A written table, to be sent to every executor if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _keyed(docs: DataFrame) -> DataFrame:
    """What tells rows of docs apart: the doc_id, null as NULL_ID, and 128 bits of the text."""
    return docs.select("text", F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), *(t.alias(f"t{i}") for i, t in enumerate(_text_hashes(F.col("text")), 1)))


def _text_hashes(text: F.Column) -> tuple[F.Column, F.Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One row per row of docs: id, t1, t2, n, and low, the (id, t1, t2) that stands for its component; null without words."""
    docs = _keyed(docs)
    one = "id bigint, t1 bigint, t2 bigint"
    rows = stash(docs.mapInArrow(_sketch(k), f"{one}, n bigint, k1 bigint, k2 bigint, sketch binary"), "sketches")
    classes = rows.where("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("id", "t1", "t2")).alias("low"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    classes = stash(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so that a class keeps its number

    bands = classes.select("node", "n", F.explode(F.sequence(F.lit(0), F.lit(M // ROWS - 1))).alias("band"), "sketch").select("node", "n", "band", F.xxhash64("band", F.expr(f"substring(sketch, {2 * ROWS} * band + 1, {2 * ROWS})")).alias("bucket"))
    same = (F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"same{i}") for i in (1, 2))
    buckets = stash(bands.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("size"), F.sum("n").alias("shingles"), *same).where("size > 1"), "buckets")
    shared = stash(bands.select("bucket", "band", "node").join(_near(buckets.select("bucket", "hub", "size")), "bucket"), "shared")

    sized = lambda name: classes.select(*(F.col(c).alias(f"{name}_{c}" if c != "node" else name) for c in ("node", "n", "sketch")))
    pairs = shared.where("node != hub").select("hub", F.col("node").alias("member")).distinct().join(sized("member"), "member").join(sized("hub"), "hub")
    pairs = pairs.where(100 * F.least("hub_n", "member_n") >= percent * F.greatest("hub_n", "member_n")).select(F.col("hub").alias("a"), F.col("member").alias("b"), "hub_n", "member_n", "hub_sketch", "member_sketch")
    pairs = stash(pairs.mapInArrow(_plausible(percent), "a bigint, b bigint"), "pairs")
    sets = _sets_of(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), k)
    x, y = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    links = stash(pairs.join(y, "b").join(x, "a").select("a", "b", "sa", "sb").mapInArrow(_confirm(percent), "a bigint, b bigint"), "links")
    found = stash(components(links).withColumnRenamed("id", "node"), "found")
    release(pairs, sets)

    more = _links_inside(docs, classes, buckets, shared, found, k, percent)
    if more is not None:
        found = stash(components(links.unionByName(more)).withColumnRenamed("id", "node"), "found")
        release(more)
    release(links, buckets, shared)

    of = found.join(classes.select("node", "low"), "node")
    lowest = stash(of.groupBy("comp").agg(F.min("low").alias("lowest")), "lowest")
    of = stash(of.join(lowest, "comp").select("node", "lowest"), "of")
    named = classes.select("k1", "k2", "node", "low").join(of, "node", "left").select("k1", "k2", F.coalesce("lowest", "low").alias("low"))
    return rows.select("id", "t1", "t2", "n", "k1", "k2").join(named, ["k1", "k2"], "left").select("id", "t1", "t2", "n", F.when(F.col("n") > 0, F.col("low")).alias("low"))


def _links_inside(docs: DataFrame, classes: DataFrame, buckets: DataFrame, shared: DataFrame, found: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Links between members of a bucket that are in different components so far; None if there is no such bucket."""
    open_ = shared.where("size > 2").join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = open_.groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.min("band").alias("band")).where("least != most").select("bucket", "band")
    split = split.join(buckets, "bucket").groupBy("size", "same1", "same2").agg(F.min(F.struct("band", "bucket")).alias("first"), F.max("shingles").alias("shingles"))
    parts = F.ceil(F.greatest(F.col("size") / BLOCK, 8 * F.col("shingles") / BLOCK_BYTES))
    split = stash(split.select("first.bucket", parts.alias("parts")), "split")
    if split.isEmpty():
        return None
    open_ = stash(open_.join(_near(split), "bucket"), "open")
    sets = _sets_of(docs, classes, open_.select("node").distinct(), k)
    profiles = sets.join(classes.select("node", "n", "sketch"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    dealt = open_.select("*", own.alias("block")).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("bucket", "band", "node", "comp", (F.col("node") == F.col("hub")).alias("is_hub"), "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    profiles = stash(profiles, "profiles")
    release(sets)
    dealt = dealt.join(profiles, "node").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "node")
    more = stash(dealt.mapInArrow(_block_links(percent), "a bigint, b bigint"), "more")
    release(open_, split, profiles)
    return more


def near_duplicates(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept."""
    real = lambda c: F.when(c != NULL_ID, c)
    comp = F.coalesce("low.id", "id")
    return _grouped(docs, k, percent).select(real(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(comp).alias("component_id"), (F.col("id") == comp).alias("kept"))


def keep_one(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, one of each component, with all their columns; rows without words all stay."""
    rows = stash(_grouped(docs, k, percent).where("n > 0"), "groups")
    one = ["id", "t1", "t2"]
    stays = F.struct(*one) == F.col("low")
    mark = "__ledgerwise_row"
    docs = docs.withColumn(mark, F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), *(t.alias(f"t{i}") for i, t in enumerate(_text_hashes(F.col("text")), 1))))
    key = lambda df: df.select(*(F.col(c).alias(f"__ledgerwise_{c}") for c in one))
    same = lambda df: (F.col(f"{mark}.id") == df["__ledgerwise_id"]) & (F.col(f"{mark}.t1") == df["__ledgerwise_t1"]) & (F.col(f"{mark}.t2") == df["__ledgerwise_t2"])
    gone = _near(stash(key(rows.where(~stays)).distinct(), "gone"))
    left = docs.join(gone, same(gone), "left_anti")
    again = stash(key(rows.where(stays).groupBy(*one).agg(F.count("*").alias("n")).where("n > 1")), "again")
    if not again.isEmpty():  # repeated rows: one of each
        again = _near(again)
        once = left.join(again, same(again), "left_semi").dropDuplicates([mark])
        left = left.join(again, same(again), "left_anti").unionByName(once)
    return left.drop(mark)


#: Rows of ids up to this many are sent to every executor (24 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def _sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The full sets of these nodes, from keyed documents."""
    need = _near(stash(classes.select("node", "low.*").join(nodes, "node"), "nodes"))
    return stash(docs.join(need, ["id", "t1", "t2"]).select("node", "text").mapInArrow(_full_sets(k), "node bigint, shingles binary").dropDuplicates(["node"]), "sets")
