"""Consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``points`` virtual nodes on a ring of 64-bit positions; a key belongs to the
arc that ends at the next node clockwise. Shards hold n / shards keys, rounded so that they
sum to n, and what overflows a full shard continues clockwise to the next node. So counts
differ by one at most, and a key moves only where a bound makes it.

Keys are counted for each arc; the walk is then done once on the arcs, of which there are
shards * points whatever the input, and its result (which ranks of which arc go where) is
looked up by every key. Repeated rows are counted before they are dealt, so a hot key is one row,
and its slots are dealt out in runs of ``RUN``. Ranks are counted in ranges of the ring, of which
there are as many as partitions, and begin after the ranges before them in the same arc.

Defined cases: null text has no bytes; null doc_ids are one key; repeated rows get slots each;
equal positions are ordered by doc_id, size and checksum; with fewer rows than shards some shards
are empty; no rows give no result; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ._store import stash

SHARDS, POINTS, RUN = 24, 64, 100_000


def ring(shards: int, points: int) -> tuple[list[int], list[int]]:
    """The nodes' positions in order, and the shard of each."""
    nodes = sorted((xxhash.xxh64_intdigest(f"shard {s} node {p}") - (1 << 63), s) for s in range(shards) for p in range(points))
    return [n for n, _ in nodes], [s for _, s in nodes]


def walk(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, from rank, to rank, shard, first slot): keys of each arc, and their overflow, dealt clockwise.

    Keys at home come first: an arc's overflow moves on only into what later arcs leave free.
    """
    n = sum(counts)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    used, out = [0] * shards, []

    def give(arc: int, a: int, b: int, s: int) -> int:
        k = min(b - a, room[s] - used[s])
        if k > 0:
            out.append((arc, a, a + k, s, used[s]))
            used[s] += k
        return a + max(0, k)

    over = [(arc, give(arc, 0, c, owners[arc]), c) for arc, c in enumerate(counts)]
    for arc, a, c in over:
        step = arc
        while a < c:
            step = (step + 1) % len(owners)
            a = give(arc, a, c, owners[step])
    return out


def assign(docs: DataFrame, shards: int = SHARDS, points: int = POINTS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    positions, owners = ring(shards, points)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    keys = docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    keys = keys.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    nodes = np.array(positions)

    @F.pandas_udf("int")
    def arc_of(position: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(nodes, position.to_numpy()) % len(nodes))

    keys = keys.withColumn("position", F.xxhash64("doc_id")).withColumn("arc", arc_of("position"))
    order = ["arc", "position", "doc_id", "size", "text_crc32"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    keys = stash(keys.withColumn("range", F.shiftright("at", 33)), "keys")  # written, so that a key keeps its range
    counted = keys.groupBy("arc", "range").agg(F.sum("copies").alias("n")).collect()  # arcs and ranges: shards * points + partitions rows at most
    before, arcs = [], [0] * len(owners)
    for r in sorted(counted):
        before.append((r.arc, r.range, arcs[r.arc]))
        arcs[r.arc] += r.n
    dealt = F.broadcast(spark.createDataFrame(walk(arcs, owners, shards), "arc int, low bigint, high bigint, shard int, slot0 bigint"))
    before = F.broadcast(spark.createDataFrame(before, "arc int, range bigint, before bigint"))
    inside = F.sum("copies").over(Window.partitionBy("arc", "range").orderBy("at"))
    ranked = keys.withColumn("inside", inside).join(before, ["arc", "range"]).withColumn("rank", F.col("before") + F.col("inside") - F.col("copies"))
    met = ranked.join(dealt, "arc").where((F.col("rank") < F.col("high")) & (F.col("rank") + F.col("copies") > F.col("low")))
    a, b = F.greatest("rank", "low"), F.least(F.col("rank") + F.col("copies"), F.col("high"))
    met = met.select("doc_id", "size", "text_crc32", "shard", (a - F.col("low") + F.col("slot0")).alias("first"), (b - F.col("low") + F.col("slot0")).alias("end"))
    runs = met.select("*", F.explode(F.sequence("first", F.col("end") - 1, F.lit(RUN).cast("bigint"))).alias("run")).repartition("shard", "run")
    return runs.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence("run", F.least(F.col("run") + RUN, "end") - 1)).alias("slot"))
