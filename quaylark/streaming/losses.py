"""Loss totals over a stream of events, by window and iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_losses(events: DataFrame, iterations: int = 100, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, iteration, events, total) of (ts, user_id, value); works on streams, where rows later
    than the watermark are dropped, and on tables. State is bounded by the watermark."""
    e = events.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % iterations + 1).cast("int").alias("iteration"), (F.col("value") * 1000).alias("amount"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    by = e.groupBy(F.window("ts", window).alias("w"), "iteration").agg(F.count(F.lit(1)).alias("events"), F.sum("amount").alias("total"))
    return by.select(F.col("w.start").alias("start"), "iteration", "events", "total")
