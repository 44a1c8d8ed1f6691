"""Tables staged in the cluster's shared folder, and who owns them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The paths of the scopes that are open, the innermost last.
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset (tests), one of our own, which is then set."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = kept.get() if kept.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Owns the paths made within it, and deletes them at its end: what was made from them must be written by then.

    Paths made outside of any scope stay, as frames that are still to run may read them, until the folder is cleared.
    """
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            delete(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; it belongs to the innermost scope."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written as Parquet in the shared folder and read again: it cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_prefix(df: DataFrame, stem: str) -> str:
    """A prefix for columns of our own that no column of df starts with, whatever its case."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(stem) for c in taken):
        stem = f"_{stem}"
    return stem
