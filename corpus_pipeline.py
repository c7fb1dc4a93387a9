"""A training corpus from documents: toxic, repeated and benchmark texts go, personal data is masked, the rest is packed.

Defined cases: null and empty texts are never toxic, repeated or contaminated and end as one end
id each; a null doc_id stays null; a doc_id that repeats on other texts stays on each; of repeated
rows one stays; very long texts are worked on whole; empty tables give empty results; all other
columns, whatever their names, come through unchanged until packing, but for n_chars of a masked text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerwise.llm import decontam, lm, packing, pii, setsketch, toxicity
from ledgerwise.llm._store import release, scratch, stash
from ledgerwise.llm.queries import TOXIC, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; learns from labels that aren't held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(lm.split_of("doc_id", 3) != 1))
    return docs.where(toxicity.scorer(spark, model)("text") < TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8 or more."""
    return setsketch.keep_one(docs, k=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than a trace of the benchmark."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    text = pii.masker(spark, pii.fit(docs))("text")
    return docs.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, cache=150_000)  # workers also hold what earlier stages left


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_benchmark), ("pii", mask_personal_data), ("packing", pack)]

#: Its stages learn, cluster and tokenise, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each written and read again; what a stage needed goes when it is done."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch() as kept:
            out = stash(stage(spark, docs, sf_dir), name)
            kept.append(out)
        release(docs)
        docs = out
    return docs
