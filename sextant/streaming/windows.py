"""Event-time windows; each function takes a batch or a streaming DataFrame with ts and value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``ts`` as a timestamp (watermarks refuse zoneless ones) with a watermark where the input is a stream."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if events.isStreaming else out


def tumbling(events: DataFrame, width: str) -> DataFrame:
    rows = timed(events).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    rows = timed(events).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first arrival of each key within the watermark (a stream), or of each key (a batch)."""
    rows = timed(events, late)
    return rows.dropDuplicatesWithinWatermark(keys) if events.isStreaming else rows.dropDuplicates(keys)
