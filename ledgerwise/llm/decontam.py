"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (an item of
fewer words is one window), and each window into shingles of ``shingle`` words. A
document can hold a window only if it holds all its shingles, so one of them is a
necessary prefix; the rarest over all documents is taken. Documents meet windows on
that shingle, must have room for the window around it (the length and positional
bounds), and are then compared word by word.

Two passes read the documents. The first counts benchmark shingles, the second emits
the few positions whose shingle can be a prefix. Both test a bitmap, the only thing that is
sent to every executor: it has ``SPARSE`` bits a shingle, 2**``LEAST`` (8 MB) at least and 2**``MOST``
(128 MB) at most, so with a very large benchmark more positions pass it, and none is lost. Everything after is an equi-join
or a partial aggregation, and takes equal texts once.

Defined cases: a null or wordless text has no words and is never contaminated; null
item ids count as the empty string; items of no words are nothing; repeated rows give
repeated results; equal windows of several items count for each item; ties between equally
rare shingles go to the first; a very long text is read whole, about 1 MB of words at a time or
itself; empty tables hit nothing. Other columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._store import stash
from ._words import ALNUM, pieces, sequence_hash

WINDOW, SHINGLE, SPARSE, LEAST, MOST = 13, 5, 64, 26, 30
#: Digests up to this many are sent to every executor (about 50 bytes each); more are joined by a shuffle.
BROADCAST_TEXTS = 500_000
_CHUNK = 15  # a bitmap chunk of Spark's bitmap functions has 2**15 bits


def _windows(window: int, shingle: int):
    """(item_id, text) batches to distinct windows per item with the hashes of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for i, j, w in pieces(b.column(1), ALNUM):
                for d in range(j - i):
                    a, z = int(w.first[d]), int(w.first[d + 1])
                    seen = set()
                    for p in range(a, max(a, z - window) + 1 if z > a else a):
                        n = min(window, z - p)
                        words = w.string(p, p + n)
                        if words not in seen:
                            seen.add(words)
                            k = min(shingle, n)
                            hs = [int(sequence_hash(w.hash[p + o : p + o + k]).view(np.int64)) for o in range(n - k + 1)]
                            rows.append((ids[i + d] or "", words, n, k, hs))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())))], names=["item", "words", "n", "k", "hs"])

    return run


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits of the column h: at most 2**(bits - 15) rows of 4 KB reach the driver."""
    slot = F.shiftrightunsigned("h", 64 - bits)
    rows = hashes.groupBy(F.shiftright(slot, _CHUNK).alias("chunk")).agg(F.bitmap_construct_agg(slot.bitwiseAND((1 << _CHUNK) - 1)).alias("bits")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        out[r.chunk << (_CHUNK - 3) : (r.chunk + 1) << (_CHUNK - 3)] = np.frombuffer(r.bits, np.uint8)
    return out


def _inside(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    slot = h >> np.uint64(64 - bits)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _count(bitmap, sizes: list[int], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for _, _, w in pieces(b.column(0), ALNUM):
                for k in sizes:
                    _, h = w.shingles(k)
                    found.append(h[_inside(bitmap.value, h, bits)])
            h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return run


def _candidates(bitmap, sizes: list[int], window: int, bits: int):
    """(key columns..., text) batches to word counts and the places that may hold a prefix shingle, with the words around."""
    kind = pa.list_(pa.struct([("pos", pa.int64()), ("h", pa.int64()), ("k", pa.int32()), ("at", pa.int64()), ("around", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, places = np.zeros(b.num_rows, np.int64), [[] for _ in range(b.num_rows)]
            for i, j, w in pieces(b.column(b.num_columns - 1), ALNUM):
                count[i:j] = np.diff(w.first)
                of = w.text_of()
                for k in sizes:
                    p, h = w.shingles(k)
                    hit = np.flatnonzero(_inside(bitmap.value, h, bits))
                    for x, y in zip(p[hit].tolist(), h[hit].view(np.int64).tolist()):
                        d = of[x]
                        a, z = int(w.first[d]), int(w.first[d + 1])
                        lo = max(a, x - window + k)
                        places[i + d].append({"pos": x - a, "h": y, "k": k, "at": lo - a, "around": w.string(lo, min(z, x + window))})
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(b.num_columns - 1)), pa.array(count), pa.array(places, kind)], names=[*b.schema.names[:-1], "n_words", "places"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, bits: int | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, md5 of the text, n_words, n_hit and the sorted item ids whose windows occur."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("md5"), "text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    owned = stash(items.mapInArrow(_windows(window, shingle), "item string, words string, n int, k int, hs array<bigint>"), "windows")
    distinct = owned.groupBy("words", "n", "k").agg(F.first("hs").alias("hs"))
    sizes = sorted(r.k for r in owned.select("k").distinct().collect())  # at most `shingle` rows
    shingles = distinct.select("words", "n", "k", F.posexplode("hs").alias("off", "h"))

    bits = bits or min(MOST, max(LEAST, (SPARSE * shingles.count()).bit_length()))
    bitmap = spark.sparkContext.broadcast(_bitmap(shingles, bits))
    seen = docs.select("text").mapInArrow(_count(bitmap, sizes, bits), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("seen"))
    prefix = shingles.join(seen, "h", "left").groupBy("words", "n", "k").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "off", "h")).alias("p"))
    prefix = stash(prefix.where("p.seen > 0").select("words", "n", "k", "p.off", "p.h"), "prefix")

    bitmap = spark.sparkContext.broadcast(_bitmap(prefix, bits))
    rows = stash(docs.mapInArrow(_candidates(bitmap, sizes, window, bits), "doc_id bigint, md5 string, n_words bigint, places array<struct<pos:bigint,h:bigint,k:int,at:bigint,around:string>>"), "places")
    once = rows.where(F.size("places") > 0).groupBy("md5").agg(F.first("n_words").alias("n_words"), F.first("places").alias("places"))  # equal texts have equal hits
    places = stash(once, "once").select("md5", "n_words", F.inline("places"))
    start = F.col("pos") - F.col("off")
    found = (
        places.join(prefix, ["h", "k"])
        .where((start >= F.col("at")) & (start + F.col("n") <= F.col("n_words")))
        .where(F.array_join(F.slice(F.split("around", " "), (start - F.col("at") + 1).cast("int"), F.col("n")), " ") == F.col("words"))
        .select("md5", start.alias("start"), "n", "words")
    )
    found = stash(found.distinct(), "found")
    hit = found.select("md5", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("w")).distinct().groupBy("md5").agg(F.count("*").alias("n_hit"))
    of = found.select("md5", "words").distinct().join(owned.select("words", "item"), "words").groupBy("md5").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per = stash(hit.join(of, "md5"), "per")  # written, so that a text of very many copies is a join that Spark can split or broadcast
    return rows.join(per, "md5", "left").select("doc_id", "md5", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated() -> F.Column:
    """At least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    bad = stash(decontaminate(docs, benchmark).where(contaminated()).select(F.col("md5").alias("_m")).distinct(), "bad")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_TEXTS else bad
    return docs.join(bad, F.md5(F.coalesce(docs["text"], F.lit(""))) == bad["_m"], "left_anti")
