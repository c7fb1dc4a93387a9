"""Tables and files that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where it is unset in local mode, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='ledgerwise-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; removed when the driver ends."""
    path = f"{shared_dir(spark)}/ledgerwise/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: a lost executor costs a reread, not a recomputation."""
    path = fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove what stash() wrote for these tables; nothing may read them any more."""
    for df in tables:
        if path := _paths.pop(df, None):
            _drop(df.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    remove(spark, path)
    _made[:] = [(s, p) for s, p in _made if p != path]


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """What is written inside goes at the end, but for the tables that are put into the list."""
    before, kept = {p for _, p in _made}, []
    yield kept
    keep = {_paths.get(df) for df in kept}
    for spark, path in list(_made):
        if path not in before | keep:
            _drop(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone already; the folder is scratch space
            return
