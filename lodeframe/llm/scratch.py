"""Shared scratch tables, partition sizing and the held-out split."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.sources.shared import discard, shared_dir  # noqa: F401
from lodeframe.sources.shared import written as cut  # noqa: F401


def is_held_out(doc_id: str) -> Column:
    """crc32 of the id as text is divisible by 5; a null id is never learnt from and counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one that begins so, that no column of ``df`` has."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512):
    """What is run inside gets Arrow batches of at most ``rows`` rows, for passes over whole texts: batches of
    the default 10,000 rows are tens of MB, of which JVM and Python hold several for each task. A session
    with its own size keeps it, and the default is back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if before == "10000":
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def merged(batches):
    """For ``mapInArrow``: the sum of a task's rows ``sums``, each the bytes of as many doubles."""
    total = None
    for b in batches:
        for x in b.column(0):
            x = np.frombuffer(x.as_py())
            total = x if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])
