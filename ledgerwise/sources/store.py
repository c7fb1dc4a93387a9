"""Parquet tables: scratch ones in the shared folder, and an append-only store of jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset in local mode, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='ledgerwise-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back, so that its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/ledgerwise/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Tables jobs, dd_rows, review_decisions and audit_log under a folder; rows are only appended."""

    NAMES = ("jobs", "dd_rows", "review_decisions", "audit_log")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def append(self, name: str, rows: DataFrame) -> None:
        if name not in self.NAMES:
            raise ValueError(f"no table {name}")
        rows.write.mode("append").parquet(f"{self.folder}/{name}")

    def has(self, name: str) -> bool:
        """Whether anything was appended to a table."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")
