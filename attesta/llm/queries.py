"""The queries of this package over the test tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import bpe, cutoffs, entities, mixing, mojibake, names, skeletons, spellings, sql, survivors
from attesta.operators.spread import spread
from attesta.sources.tables import table

_FIELDS = {"doi": spellings.canonical_doi, "url": spellings.canonical_url}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spellings.copies(table(spark, d, "academic_sources"), "rec_id", _FIELDS)


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return spellings.collapse(table(spark, d, "academic_sources"), "rec_id", _FIELDS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    persons = table(spark, d, "author_registry").select(F.lit("author").alias("kind"), F.col("author_id").cast("bigint").alias("entity_id"), F.col("full_name").alias("name"))
    journals = table(spark, d, "journals").select(F.lit("journal").alias("kind"), F.col("journal_id").cast("bigint").alias("entity_id"), F.col("journal_name").alias("name"))
    said = names.mentions(table(spark, d, "academic_sources"), table(spark, d, "profiles"))
    return names.link(said, persons.unionByName(journals)).where(~F.col("exact")).select("kind", "row_id", "slot", "entity_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    a = skeletons.prints(table(spark, d, "academic_sources"), "rec_id", ["content"])
    e = skeletons.prints(table(spark, d, "evidence_items"), "item_id", ["evidence", "claim"])
    return skeletons.pairs(a.unionByName(e))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    a = skeletons.prints(table(spark, d, "academic_sources"), "rec_id", ["content"])
    e = skeletons.prints(table(spark, d, "evidence_items"), "item_id", ["evidence", "claim"])
    return skeletons.classes(a.unionByName(e)).select("field", "rid", "class_id")


def p3_normalised(spark: SparkSession, d: str) -> DataFrame:
    a = skeletons.normalised(table(spark, d, "academic_sources"), "rec_id", ["content"])
    e = skeletons.normalised(table(spark, d, "evidence_items"), "item_id", ["evidence", "claim"])
    return a.unionByName(e)


def _endings(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "academic_sources").select(F.lit("academic_sources").alias("part"), F.col("rec_id").alias("rid"), "source", F.col("content").alias("body"))
    e = table(spark, d, "evidence_items").select(F.lit("evidence_items").alias("part"), F.col("item_id").alias("rid"), F.col("harvested_from").alias("source"), F.col("evidence").alias("body"))
    return cutoffs.verdicts(a.unionByName(e))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _endings(spark, d).where("cut").select(F.col("part").alias("table_name"), F.col("rid").alias("row_id"))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return cutoffs.shares(_endings(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", bpe.token_ids(F.col("text")).alias("ids"))


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    return entities.matches(table(spark, d, "academic_sources"), "rec_id", table(spark, d, "registry_works"), "work_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_matches(spark, d).select("rec_id", "work_id")


# the fields that stand and fall together: where a work appeared, what it says, whose it is
_BUNDLES = (survivors.venue(others=("year", "doi", "citation_count")), survivors.content(others=("url", "is_open_access")), survivors.authors(others=("title",)))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "merge_candidates"), "canonical_id", "cand_id", "fetched_at", _BUNDLES)


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return survivors.records(table(spark, d, "merge_candidates"), "canonical_id", "cand_id", "fetched_at", _BUNDLES)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored(table(spark, d, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_collapsed, p2_found, p3_found, p3_classes, p3_normalised, p4_found, p4_shares, p5_found, p5_matches, p6_found, p6_records, p7_ids, p8_mix, p8_shares, p9_found, p9_restored)
}

ORACLE: dict[str, str] = sql.SQL
