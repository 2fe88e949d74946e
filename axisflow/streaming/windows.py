"""Event-time windows, the same on batch and stream input; an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_counts(events: DataFrame, length: str = "4 hours", shift: str = "1 hour", late: str | None = None) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    out = rows.groupBy(F.window("ts", length, shift)).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.unix_seconds("window.start").alias("start"), F.unix_seconds("window.end").alias("stop"), "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    out = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_micros("session_window.start").alias("start"), F.unix_micros("session_window.end").alias("stop"), "n")
