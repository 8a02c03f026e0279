"""Incremental forms: windowed request metrics, first-seen dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_metrics(log: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Per window and route of a stream `log` (ts, route, duration, failed); append mode emits a window when the
    watermark passes it."""
    by = log.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "route")
    return by.agg(F.count(F.lit(1)).alias("requests"), F.count_if("failed").alias("errors"), F.max("duration").alias("max_duration")).select(F.col("w.start").alias("window_start"), "route", "requests", "errors", "max_duration")


def first_seen(rows: DataFrame, key: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; later repeats are dropped (unlike the batch form, where the
    last wins)."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
