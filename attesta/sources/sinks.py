"""Writing what a run leaves behind, and reading the topics it starts from.

Every sink takes a frame and writes one part a run, so no report passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.sources.cache import fresh


def topics(spark: SparkSession, path: str, quick: bool = False) -> DataFrame:
    """``(pos, topic, type)`` of a JSON list of topics; the first two if ``quick``. An empty list gives no rows."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<struct<topic:string,type:string>>").alias("x"))
    out = raw.select(F.posexplode("x").alias("pos", "t")).select("pos", "t.topic", "t.type")
    return out.where("pos < 2") if quick else out


def file_name(topic: Column, at: Column, ending: str = "") -> Column:
    """A name for what is written of a topic: the time, then its letters and digits, at most sixty."""
    safe = F.replace(F.trim(F.regexp_replace(topic, r"[^\p{L}\p{N} _-]", "_")), F.lit(" "), F.lit("_"))
    return F.concat(F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(safe, 1, 60), F.lit(ending))


def save_texts(texts: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """One part a name below ``path``: reports, scorecards, recommendations and summaries. Written again, a name's text is replaced."""
    out = texts.select(F.col(name).alias("name"), F.col(text).alias("text")).where("name IS NOT NULL AND text IS NOT NULL")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").text(path)


def save_cache(entries: DataFrame, path: str, at: str = "cached_at") -> None:
    """Adds entries with the time they were made, as JSON lines."""
    entries.withColumn(at, F.coalesce(F.col(at), F.current_timestamp()) if at in entries.columns else F.current_timestamp()).write.mode("append").json(path)


def read_cache(spark: SparkSession, path: str, schema: str, key: str, now: Column, hours: float, at: str = "cached_at") -> DataFrame:
    """The last entry of each key that is at most ``hours`` old at ``now``."""
    x = fresh(spark.read.schema(schema).json(path), at, now, hours).where("hit").drop("hit")
    return x.groupBy(key).agg(F.max_by(F.struct(*[c for c in x.columns if c != key]), at).alias("v")).select(key, "v.*")


def clear_cache(spark: SparkSession, path: str, schema: str, now: Column, hours: float, into: str, at: str = "cached_at") -> None:
    """Writes the entries that are still good to ``into``, a new folder, so that a failure loses nothing."""
    fresh(spark.read.schema(schema).json(path), at, now, hours).where("hit").drop("hit").write.mode("overwrite").json(into)
