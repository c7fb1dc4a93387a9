"""Lineage between objects: edges, components, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.store import stash


def edges(objects: DataFrame) -> DataFrame:
    """src, dst, reason of objects (object_id, pos, name, tables_read, tables_written, called)."""
    wrote = objects.select(F.col("object_id").alias("src"), F.col("pos").alias("p"), F.explode("tables_written").alias("t")).withColumn("t", F.lower("t"))
    read = objects.select(F.col("object_id").alias("dst"), F.explode("tables_read").alias("t")).withColumn("t", F.lower("t"))
    flow = wrote.join(read, "t").where("src <> dst").select("src", "dst", F.lit("read_after_write").alias("reason"), F.lit(1).alias("rank"))
    called = objects.select(F.col("object_id").alias("src"), F.explode("called").alias("c"))
    named = objects.select(F.col("object_id").alias("dst"), F.lower("name").alias("n"))
    calls = called.join(named, F.lower("c") == F.col("n")).where("src <> dst").select("src", "dst", F.lit("explicit_call").alias("reason"), F.lit(2).alias("rank"))
    strong = flow.unionByName(calls).groupBy("src", "dst").agg(F.max_by("reason", "rank").alias("reason"))
    second = wrote.select(F.col("src").alias("dst"), F.col("p").alias("q"), "t")
    weak = wrote.join(second, "t").where("p < q").select("src", "dst").distinct()
    taken = strong.select("src", "dst").unionByName(strong.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    weak = weak.join(taken, ["src", "dst"], "left_anti").withColumn("reason", F.lit("shared_write_target_weak"))
    return strong.unionByName(weak)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """object_id, chain (the smallest id of its weakly connected component); the rounds are written, not recomputed."""
    pairs = links.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    pairs = stash(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    label = stash(nodes.select(F.col("object_id").alias("id"), F.col("object_id").alias("chain")), "labels")
    while True:
        near = pairs.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("chain").alias("low"))
        new = label.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("chain", "low").alias("chain"), (F.col("low") < F.col("chain")).alias("moved"))
        hop = new.select(F.col("id").alias("h"), F.col("chain").alias("root"))  # pointer jumping halves long paths
        new = stash(new.join(hop, F.col("chain") == F.col("h")).select("id", F.least("chain", "root").alias("chain"), "moved"), "labels")
        if new.where("moved").isEmpty():
            return new.select(F.col("id").alias("object_id"), "chain")
        label = new.drop("moved")


def orders(objects: DataFrame, links: DataFrame) -> DataFrame:
    """chain, object_id, level, confidence: the longest path before each object; a chain with a cycle is ordered by pos, and low."""
    chains = components(objects, links)
    left = stash(objects.select("object_id", "pos").join(chains, "object_id"), "left")
    links = links.select("src", "dst").distinct()
    done, level = None, 0
    while True:
        waits = links.join(left.select(F.col("object_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("object_id")).distinct()
        free = stash(left.join(waits, "object_id", "left_anti").withColumn("level", F.lit(level)), "free")
        if free.isEmpty():
            break
        done = free if done is None else stash(done.unionByName(free), "done")
        left = stash(left.join(free, "object_id", "left_anti"), "left")
        level += 1
    stuck = left.select("chain").distinct().withColumn("cycle", F.lit(True))
    everyone = left.withColumn("level", F.lit(None).cast("int"))
    everyone = everyone if done is None else done.unionByName(everyone)
    out = everyone.join(stuck, "chain", "left").withColumn("cycle", F.coalesce("cycle", F.lit(False)))
    return out.select("chain", "object_id", "pos", F.when(~F.col("cycle"), F.col("level")).alias("level"), F.when(F.col("cycle"), "low").otherwise("high").alias("confidence"))


def chain_models(order: DataFrame, objects: DataFrame) -> DataFrame:
    """One row per chain: its objects in order, sorted evidence, and the mean confidence (at most 0.6 where the order is low)."""
    each = order.join(objects.select("object_id", "name", "tables_read", "tables_written", F.col("confidence").alias("c")), "object_id")
    place = F.struct(F.coalesce("level", F.lit(0)).alias("l"), "pos", "object_id")
    out = each.groupBy("chain").agg(
        F.transform(F.array_sort(F.collect_list(place)), lambda x: x["object_id"]).alias("order"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("name"), "tables_read", "tables_written"))))).alias("evidence"),
        F.avg("c").alias("mean"),
        F.first("confidence").alias("order_confidence"),
    )
    return out.select("chain", "order", "evidence", "order_confidence", F.round(F.when(F.col("order_confidence") == "low", F.least("mean", F.lit(0.6))).otherwise(F.col("mean")), 3).alias("confidence"))
