"""Results kept for a time: a table instead of files, with the time as a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(cache: DataFrame, at: str, now: Column, hours: float) -> DataFrame:
    """``cache`` with ``hit``: whether the entry is at most ``hours`` old at ``now``; entries without a time are no hits."""
    age = (F.unix_micros(now) - F.unix_micros(F.col(at))) / 3.6e9
    return cache.withColumn("hit", F.coalesce(age <= hours, F.lit(False)))


def missing(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """The rows whose key the cache doesn't hold."""
    return wanted.join(cache.select(key).distinct(), key, "left_anti")
