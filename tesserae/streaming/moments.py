"""An extension: mergeable moments over a stream, and event-time windows of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators.aggregate import finish_moments


def stream_tables(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_moments(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean and variance per key so far; for update or complete mode."""
    v = F.col(value)
    return finish_moments(stream.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2")))


def windowed_moments(stream: DataFrame, keys: list[str], value: str, time: str, window: str, late: str) -> DataFrame:
    """The same per event-time window; a window closes once the watermark passes it."""
    v = F.col(value)
    timed = stream.withWatermark(time, late).groupBy(F.window(time, window), *keys)
    return finish_moments(timed.agg(F.count(v).alias("n"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2")))
