"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, in local mode only, a folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/hyperloom-shared"


def scratch(spark: SparkSession, kind: str = "frame") -> str:
    """A new path in the shared folder; it is deleted when the application ends."""
    path = f"{shared_root(spark)}/hyperloom/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: The paths that ``released`` blocks have collected, innermost last.
_collected: list[list[str]] = []


@contextmanager
def released(spark: SparkSession):
    """Deletes, at its end, what ``stored`` has written within: for results that nothing reads afterwards."""
    _collected.append([])
    try:
        yield
    finally:
        for path in _collected.pop():
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, kind: str = "frame") -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives the loss of executors."""
    path = scratch(df.sparkSession, kind)
    if _collected:
        _collected[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
