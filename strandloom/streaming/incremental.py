"""Incremental dereplication, counts and windows over streams of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def stream_counts(records: DataFrame, keys: list[str]) -> DataFrame:
    """Reads by key, kept up to date (complete or update mode)."""
    return records.groupBy(*keys).agg(F.sum("count").alias("count"))


def stream_distinct(records: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """The first record of each key; state older than the watermark goes."""
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, delay: str, window: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """(start, end, keys..., n, weight) by tumbling, or with ``slide`` sliding, windows of event time; late events count until the watermark passes."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    out = events.withWatermark(time, delay).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "weight")


def sessions(events: DataFrame, time: str, delay: str, gap: str, keys: list[str]) -> DataFrame:
    """(start, end, keys..., n) of runs of events without a gap as long as ``gap``."""
    out = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """Any operator on each micro-batch, appended to Parquet under the batch's number, so that a batch that runs again writes the same folder anew."""

    def run(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
