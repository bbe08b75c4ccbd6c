"""Tumbling, sliding and session windows with watermarks; the same function serves batch frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files with a declared schema."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def windowed(df: DataFrame, ts: str, length: str, keys: list[str], aggregates: list[Column], slide: str | None = None, late: str = "10 minutes", session: bool = False) -> DataFrame:
    """``window_start, window_end, *keys, *aggregates``. Rows later than ``late`` behind the newest are dropped
    from a stream; a batch frame has no late rows. ``session``: windows that end after a gap of ``length``."""
    at = F.col(ts).cast("timestamp")
    df = df.withColumn(ts, at)
    if df.isStreaming:
        df = df.withWatermark(ts, late)
    w = F.session_window(ts, length) if session else F.window(ts, length, slide)
    out = df.groupBy(w.alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *[c for c in out.columns if c not in ("w", *keys)])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Takes all that is there, writes it as Parquet exactly once, and stops."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
