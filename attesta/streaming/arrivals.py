"""Deduplication and counts over arriving sources and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.identity import canonical_id


def first_arrivals(sources: DataFrame, at: str = "fetched_at", late: str = "21 days") -> DataFrame:
    """The first arrival of each canonical source; state older than the latest time less ``late`` is dropped."""
    keyed = sources.withColumn("canonical_id", canonical_id(F.col("doi"), F.col("url"), F.col("title"))).where("canonical_id IS NOT NULL")
    return keyed.withWatermark(at, late).dropDuplicatesWithinWatermark(["canonical_id"])


def counts_by_window(events: DataFrame, at: str, key: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``(start, end, key, n)`` in tumbling (or, with ``slide``, sliding) windows, final once the watermark has passed."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    g = events.withWatermark(at, late).groupBy(w, F.col(key)).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``(start, end, key, n)`` of stretches of events of one key without a longer gap."""
    g = events.withWatermark(at, late).groupBy(F.session_window(at, gap), F.col(key)).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")
