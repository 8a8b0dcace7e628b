"""Streams of hits: running counts by family in event-time windows, and new reports as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed_counts(stream: DataFrame, time: str, group: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, sum and maximum by group and window; rows later than the watermark are dropped."""
    w = F.window(time, window)
    out = _timed(stream, time, late).groupBy(w, group).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("top"))
    return out.select(F.col("window.start").alias("window_start"), group, "n", "total", "top")


def first_seen(stream: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of every key inside the watermark."""
    return _timed(stream, time, late).dropDuplicatesWithinWatermark(keys)


def parquet_stream(spark: SparkSession, folder: str, schema, files_a_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything there is now, into Parquet; a second call goes on where this one ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
