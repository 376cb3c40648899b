"""How far a source can be trusted, by its address, title and content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import lexicon as lx
from attesta.functions.identity import url_host
from attesta.functions.text import topic_words


def _on_domain(host: Column, domains) -> Column:
    """Whether the host is one of the domains or below one: some suffix of it at a dot is in the list."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, 1000), "."))
    return F.arrays_overlap(suffixes, F.array(*map(F.lit, domains)))


def _any_in(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def is_trusted(url: Column) -> Column:
    host = url_host(url)
    suffix = F.lit(False)
    for s in lx.TRUSTED_SUFFIXES:
        suffix = suffix | F.endswith(host, F.lit(s))
    return suffix | _on_domain(host, lx.TRUSTED_DOMAINS)


def is_junk(url: Column, title: Column, content: Column) -> Column:
    """Whether a result is no source: no host, adult or junk host, a shop's title or content, a bare encyclopaedia word."""
    url, title, content = (F.coalesce(c, F.lit("")) for c in (url, title, content))
    host, low = url_host(url), F.lower(url)
    slug = F.regexp_replace(F.element_at(F.split(low, r"wikipedia\.org/wiki/"), -1), "^/+|/+$", "")
    return (
        (host == "") | _any_in(host, lx.ADULT_HOST_PARTS) | _on_domain(host, lx.JUNK_DOMAINS) | _any_in(F.lower(title), lx.JUNK_TITLES)
        | (~is_trusted(url) & _any_in(F.lower(content), lx.SHOP_CONTENTS))
        | (F.contains(low, F.lit("wikipedia.org/wiki/")) & slug.isin(lx.WIKI_SLUGS))
    )


def tier(url: Column, title: Column, content: Column) -> Column:
    """1 for institutions and publishers, 2 for other pages, 3 for what is no source."""
    url = F.coalesce(url, F.lit(""))
    return F.when(is_junk(url, title, content), 3).when(is_trusted(url), 1).otherwise(2)


def source_type(publication_types: Column, venue: Column, url: Column) -> Column:
    """journal, conference, preprint or report: by the types given, else by words of venue and address."""
    kinds = F.transform(F.coalesce(publication_types, F.array().cast("array<string>")), F.lower)
    has = lambda *names: F.arrays_overlap(kinds, F.array(*map(F.lit, names)))
    v = F.lower(F.coalesce(venue, F.lit("")))
    both = F.concat(v, F.lit(" "), F.lower(F.coalesce(url, F.lit(""))))
    return (
        F.when(has("journalarticle", "journal-article"), "journal").when(has("conferencepaper", "proceedings-article"), "conference")
        .when(has("preprint", "posted-content"), "preprint").when(has("report", "techreport"), "report")
        .when(_any_in(both, lx.PREPRINT_WORDS), "preprint").when(_any_in(both, lx.CONFERENCE_WORDS), "conference")
        .when(v != "", "journal").otherwise("report")
    )


def keep_all_if_none(df: DataFrame, good: Column, scope: list[str]) -> DataFrame:
    """The good rows of each scope; all rows of a scope without any.

    The scopes without a good row are found by an aggregate, so no scope has to fit into one task.
    """
    flagged = df.withColumn("__good", F.coalesce(good, F.lit(False)))
    has = flagged.groupBy(*scope).agg(F.max("__good").alias("__any")).where("__any").drop("__any")
    kept = flagged.where("__good")
    rest = flagged.join(has, scope, "left_anti")
    return kept.unionByName(rest).drop("__good")


def relevant(df: DataFrame, topic: Column, least: int, stop, scope: list[str]) -> DataFrame:
    """Rows whose title or content contains at least ``least`` of the topic's words (or all, if it has fewer)."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    words = topic_words(topic, stop)
    hits = F.size(F.filter(words, lambda w: F.contains(text, w)))
    return keep_all_if_none(df, hits >= F.least(F.lit(least), F.size(words)), scope)

