"""Positions within a scope that may be larger than any task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from attesta.operators.durable import durable


def with_rank(df: DataFrame, scope: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with the position of each row in its scope, from 1.

    Rows are range-partitioned by scope and order, so a large scope lies in several partitions; positions are counted
    within a partition and moved by the number of rows of the scope in earlier ones. ``order`` has to be total.
    """
    x = durable(df.repartitionByRange(*[F.col(c) for c in scope], *[F.col(o) if isinstance(o, str) else o for o in order]).withColumn("__part", F.spark_partition_id()))
    parts = x.groupBy(*scope, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*scope).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = parts.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(scope)], F.col("__part").alias("__p"), before.alias("__before"))
    local = x.withColumn("__at", F.row_number().over(W.partitionBy(*scope, "__part").orderBy(*order)))
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(scope):
        same = same & F.col(c).eqNullSafe(F.col(f"__s{i}"))
    out = local.join(shift, same, "left").withColumn(name, (F.col("__at") + F.col("__before")).cast("bigint"))
    return out.drop("__part", "__p", "__at", "__before", *[f"__s{i}" for i in range(len(scope))])
