"""Daily metrics kept up to date as events arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def daily_metrics_stream(events: DataFrame, key: str, ts: str, value: Column, lateness: str = "2 days") -> DataFrame:
    """(series, day, n, value) per event-time day. Late rows count until the watermark passes their day."""
    rows = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", lateness)
    daily = rows.groupBy(F.window("_at", "1 day"), F.col(key).alias("series")).agg(F.count("*").alias("n"), value.alias("value"))
    return daily.select("series", F.to_date("window.start").alias("day"), "n", "value")
