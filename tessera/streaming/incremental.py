"""Frames that arrive over time: running ranges, histograms and normal equations by Structured Streaming.

Each micro-batch is reduced to a small partial table (minima and counts, or upper-triangle sums), kept under its batch
number: a batch that is delivered again overwrites its own partial, so nothing is counted twice. The total is the merge
of the partials, which commutes; watermarks are not needed because no state waits for late rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run(stream: DataFrame, reduce: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that writes reduce(batch) to folder/batch=<number> for each micro-batch.

    A batch must hold whole frames: a pair of sites is found only if both arrive in one batch (one file a frame, say).
    """

    def keep(batch: DataFrame, number: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merged_ranges(spark: SparkSession, folder: str, by: list[str]) -> DataFrame:
    """Ranges (by, lo, hi, n) over all batches so far."""
    parts = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    return parts.groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def merged_sums(spark: SparkSession, folder: str, by: list[str], value: str = "v") -> DataFrame:
    """Sums (by, value) over all batches so far: normal equations, histograms."""
    parts = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    return parts.groupBy(*by).agg(F.sum(value).alias(value))


def frame_blocks(sites: DataFrame, size: int, start: int = 0) -> DataFrame:
    """Adds block_id: frames in runs of `size`."""
    return sites.withColumn("block_id", F.floor((F.col("frame_id") - start) / size).cast("int"))


def windowed_counts(events: DataFrame, time: str, every: str, late: str, by: list[str]) -> DataFrame:
    """Counts, least and greatest `value` by event-time window; rows later than `late` are left out when streaming."""
    return events.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), *by).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
