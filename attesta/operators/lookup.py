"""Joins that try several keys in turn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import one_line


def fallback_lookup(left: DataFrame, levels: Sequence[tuple[Column, DataFrame]], value: str) -> DataFrame:
    """``left`` with ``value`` from the first level whose key is known.

    Each level is a key of the left side and a table ``(k, value)`` with one row per key. A key that is NULL finds nothing. Each level is an
    equi-join on a table that was aggregated before, so a key that many rows share is looked up, not multiplied.
    """
    out, found = left, []
    for i, (key, table) in enumerate(levels):
        out = out.withColumn(f"__k{i}", key).join(table.select(F.col("k").alias(f"__k{i}"), F.col(value).alias(f"__v{i}")), f"__k{i}", "left")
        found.append(F.col(f"__v{i}"))
    out = out.withColumn(value, F.coalesce(*found))
    return out.drop(*[c for i in range(len(levels)) for c in (f"__k{i}", f"__v{i}")])


def _given(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def _pair(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit("\n"), b))


def loose_claim(c: str = "claim") -> Column:
    """A claim in lower case on one line; NULL if it is blank."""
    x = F.lower(one_line(F.coalesce(F.col(c), F.lit(""))))
    return F.when(x != "", x)


def last_label(evidence: DataFrame, verdicts: DataFrame, order: str) -> DataFrame:
    """``evidence`` with the ``label`` and ``confidence`` of the last verdict for its id, else its source and claim, else its claim."""
    keys = (_given("evidence_id"), _pair(_given("source_key"), loose_claim()), loose_claim())
    def level(k: Column) -> DataFrame:
        return verdicts.withColumn("k", k).where("k IS NOT NULL").groupBy("k").agg(F.max_by(F.struct("label", "confidence"), order).alias("verdict"))
    out = fallback_lookup(evidence, [(k, level(k)) for k in keys], "verdict")
    return out.select(*evidence.columns, F.col("verdict.label").alias("label"), F.col("verdict.confidence").alias("confidence"))


def agreed_label(evidence: DataFrame, verdicts: DataFrame, url_form) -> DataFrame:
    """``evidence`` with the ``label`` all verdicts of the first matching key agree on; UNVERIFIED if they differ or there is none."""
    from attesta.functions.text import strip

    claim = F.when(strip(F.coalesce(F.col("claim"), F.lit(""))) != "", strip(F.col("claim")))
    url = F.when(url_form(F.col("source_url")) != "", url_form(F.col("source_url")))
    keys = (_given("evidence_id"), _pair(_given("source_key"), claim), _pair(url, claim), claim)
    upper = F.upper(F.when(F.col("label") != "", F.col("label")).otherwise(F.lit("UNVERIFIED")))
    upper = F.coalesce(upper, F.lit("UNVERIFIED"))
    def level(k: Column) -> DataFrame:
        g = verdicts.withColumn("k", k).where("k IS NOT NULL").groupBy("k").agg(F.min(upper).alias("lo"), F.max(upper).alias("hi"))
        return g.select("k", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit("UNVERIFIED")).alias("label"))
    out = fallback_lookup(evidence.drop("label"), [(k, level(k)) for k in keys], "label")
    return out.withColumn("label", F.coalesce("label", F.lit("UNVERIFIED")))
