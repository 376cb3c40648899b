"""Giving every core something to do before work in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores; unchanged if it has them.

    Meant for scans: a table in few files is read by few tasks, which is too slow when each row costs much. The rows are
    dealt out in turn, so no key can make a partition large.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
