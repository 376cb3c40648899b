"""Putting together what searches return: one list of a run from several providers, rounds and queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import identity as idy
from attesta.functions import text as tx
from attesta.operators.durable import durable
from attesta.operators.ordered import alike_first_wins, first_wins, first_wins_if_given
from attesta.operators.trust import keep_all_if_none, tier

# The order in which providers count, and titles that are none.
PROVIDERS = ("Semantic Scholar", "OpenAlex", "Crossref")
NO_TITLES = ("untitled", "unknown title", "none", "no title")
ALIKE = 0.85


def without_tags(c: Column) -> Column:
    """An abstract without the tags of its markup."""
    return tx.one_line(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))


def provider_rank(provider: Column) -> Column:
    out = F.lit(len(PROVIDERS))
    for i, name in reversed(list(enumerate(PROVIDERS))):
        out = F.when(provider == name, i).otherwise(out)
    return out


def merged_search(results: DataFrame, retracted: Column, scope: Sequence[str] = ("run_id",), order: str = "pos") -> DataFrame:
    """The academic results of each run as one list with its ``place`` order: providers in their order of priority, then by place.

    OpenAlex rows that are ``retracted`` are left out, Crossref abstracts lose their tags. Of rows with one DOI, one address or titles alike the
    first stays; rows without abstract go if any has one. Rows without a title, or only a word for it, are no results.
    """
    x = results.where(~((F.col("source") == "OpenAlex") & F.coalesce(retracted, F.lit(False))))
    x = x.withColumn("content", F.when(F.col("source") == "Crossref", without_tags(F.col("content"))).otherwise(F.col("content")))
    title = tx.strip(F.coalesce("title", F.lit("")))
    x = x.where((title != "") & ~F.lower(title).isin(*NO_TITLES)).withColumn("place", F.struct(*scope, provider_rank(F.col("source")).alias("prio"), F.col(order).cast("bigint").alias("pos")))
    x = first_wins_if_given(x, idy.dedup_doi(F.col("doi")), scope, ["place"])
    x = first_wins_if_given(x, F.lower(tx.strip(F.coalesce("url", F.lit("")))), scope, ["place"])
    x = durable(x.withColumn("__t", F.filter(F.split(tx.title_form(F.col("title")), " "), lambda w: w != "")))
    kept = alike_first_wins(x, scope, "place", "__t", ALIKE).drop("__t")
    return keep_all_if_none(kept, F.coalesce("content", F.lit("")) != "", list(scope))


def web_results(results: DataFrame, strict: bool = False, scope: Sequence[str] = ("run_id",), order: str = "pos") -> DataFrame:
    """Web results without junk, the first of each address; only institutions and publishers if ``strict``."""
    x = results.withColumn("tier", tier(F.col("url"), F.col("title"), F.col("content"))).withColumn("__u", idy.web_url(F.col("url")))
    return first_wins(x.where((F.col("tier") <= (1 if strict else 2)) & (F.col("__u") != "")), [*scope, "__u"], [order]).drop("__u")


def merged_sources(old: DataFrame, new: DataFrame, scope: Sequence[str] = ("run_id",), order: str = "pos") -> DataFrame:
    """Sources of an earlier and a later round, the first of each address as research compares them; rows without one are none."""
    both = old.withColumn("__round", F.lit(0)).unionByName(new.withColumn("__round", F.lit(1))).withColumn("__u", idy.research_url(F.col("url")))
    return first_wins(both.where("coalesce(__u, '') <> ''"), [*scope, "__u"], ["__round", order]).drop("__u", "__round")


def gap_queries(topic: Column) -> Column:
    """The queries that look for open problems of a topic, in order."""
    return F.array(F.concat(F.lit("open problems unsolved challenges "), topic), F.concat(F.lit("future research directions gaps "), topic))


def gap_hits(hits: DataFrame, scope: Sequence[str] = ("run_id",), query: str = "query", order: str = "pos") -> DataFrame:
    """The hits of all gap queries of a run, the first of each address in lower case."""
    x = hits.withColumn("__u", F.lower(tx.strip(F.coalesce("url", F.lit("")))))
    return first_wins(x.where("__u <> ''"), [*scope, "__u"], [query, order]).drop("__u")


def first_answering(results: DataFrame, scope: Sequence[str] = ("run_id",), provider: str = "provider_rank") -> DataFrame:
    """The rows of the first provider of each scope that has any: a chain of fallbacks as an aggregate and a join."""
    first = results.groupBy(*scope).agg(F.min(provider).alias(provider))
    return results.join(first, [*scope, provider], "left_semi")


def new_sources(found: DataFrame, known: DataFrame, scope: Sequence[str] = ("run_id",)) -> DataFrame:
    """The rows of ``found`` whose address and DOI are both unknown in their scope."""
    keys = lambda d: F.array_compact(F.array(F.nullif(F.concat(F.lit("u"), F.lower(tx.strip(F.coalesce("url", F.lit(""))))), F.lit("u")), F.nullif(F.concat(F.lit("d"), idy.literature_doi(F.col("doi"))), F.lit("d"))))
    have = known.select(*scope, F.explode(keys(known)).alias("__k")).distinct()
    x = found.withColumn("__id", F.xxhash64(*scope, "url", "doi"))
    seen = x.select(*scope, "__id", F.explode(keys(x)).alias("__k")).join(have, [*scope, "__k"], "left_semi").select("__id").distinct()
    return x.join(seen, "__id", "left_anti").drop("__id")
