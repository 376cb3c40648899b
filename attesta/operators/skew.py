"""Joins and lookups that hold when one key has a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the rows, so there are at most 256 hot keys whatever the data.
HOT_SHARE = 1 / 256
#: Tables below this many rows are not worth salting.
SMALL = 100_000


def hot_keys(counts: DataFrame, key: str, n: str = "n", share: float = HOT_SHARE) -> list:
    """The keys of ``counts`` (one row per key with its row count in ``n``) that hold more than ``share`` of all rows.

    At most ``1 / share`` keys come to the driver. Empty for an empty table or for fewer than ``SMALL`` rows.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    if total < SMALL:
        return []
    return [r[0] for r in counts.where(F.col(n) > share * total).select(key).collect()]


def salted_lookup(big: DataFrame, small: DataFrame, key: str, hot: Sequence, spread: str, how: str = "inner", salts: int = 64) -> DataFrame:
    """``big`` joined to ``small`` (one row per ``key``) with the rows of the hot keys spread over ``salts`` parts.

    ``spread`` is a column of ``big`` that differs within a key. Rows with a NULL key find no partner (``inner``) or
    stay alone (``left``). No row is lost or doubled.
    """
    if not hot:
        return big.join(small, key, how)
    values = list(hot)
    is_hot = F.col(key).isin(values)
    b = big.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    s = small.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return b.join(s, [key, "__salt"], how).drop("__salt")
