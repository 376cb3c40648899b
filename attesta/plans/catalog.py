"""All queries of the core library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attesta.plans import core, harvest, intake, sql

FLAGSHIP = core.c_consensus


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return core.Q | intake.Q | harvest.Q


def oracle() -> dict[str, str]:
    return sql.SQL | intake.SQL | harvest.SQL
