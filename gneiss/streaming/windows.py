"""The stream side: the column passes run on streams as they are; what needs state is counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.tokens import Counter, words


def timed(df: DataFrame, late: str) -> DataFrame:
    """Event time as a timestamp (watermarks take no other), with a watermark on streams."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if df.isStreaming else df


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): counts in windows of event time, for batches and streams alike."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    d = timed(events, late)
    return d.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, stop, n): runs of a user's events without a longer pause."""
    d = timed(events, late)
    return d.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def line_counts(docs: DataFrame, width: str = "1 hour", late: str = "2 hours", count: Counter = words) -> DataFrame:
    """(start, line, n, tokens): how often lines recur among the documents that arrive in a window (ts, text)."""
    d = timed(docs, late).select("ts", F.explode(F.split("text", "\n")).alias("line")).filter(F.trim("line") != "")
    g = d.groupBy(F.window("ts", width).alias("w"), F.trim("line").alias("line")).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "line", "n", count(F.col("line")).alias("tokens"))
