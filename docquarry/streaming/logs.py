"""Streaming forms of the log operators; watermarks bound their state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators.dedupe import fingerprint


def first_arrivals(stream: DataFrame, at: str, text: str, late: str = "1 hour") -> DataFrame:
    """Rows whose normalised text has not come within ``late`` before."""
    return stream.withColumn("fp", fingerprint(F.col(text))).withWatermark(at, late).dropDuplicatesWithinWatermark(["fp"])


def sessions(stream: DataFrame, by: str, at: str, idle: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """(by, started, ended, events) for sessions that a gap of ``idle`` has closed."""
    out = stream.withWatermark(at, late).groupBy(by, F.session_window(at, idle).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(by, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def event_counts(stream: DataFrame, kind: str, at: str, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(kind, start, events) per tumbling window, or sliding with ``slide``."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, late).groupBy(kind, window.alias("w")).agg(F.count(F.lit(1)).alias("events")).select(kind, F.col("w.start").alias("start"), "events")
