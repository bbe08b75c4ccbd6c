"""Tables written to the folder that all executors share, to end a lineage or to fix an order."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode with none set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodeframe-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_scopes: list[list[str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    path = f"{shared_dir(spark)}/lodeframe-{uuid.uuid4().hex}/{label}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scope(spark: SparkSession):
    """Tables written to the shared folder inside are deleted at the end; what a query returns must have been read by then.

    with scope(spark):
        query(spark, sf_dir).write.parquet(path)
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._lodeframe_path = path
    return back


def remove(spark: SparkSession, path: str) -> None:
    """Delete what ``fresh_path`` gave, with the folder made for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p.getParent(), True)


def discard(df: DataFrame) -> None:
    """Delete a table that ``written`` made, once nothing reads it any more."""
    path = getattr(df, "_lodeframe_path", None)
    if path:
        remove(df.sparkSession, path)
