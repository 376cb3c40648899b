"""Checking a paper's identity against two registries."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import lexicon as lx
from attesta.functions.text import jaccard

UNREACHED = ("TIMEOUT", "UNAVAILABLE", "RATE_LIMITED")


def _family(author: Column) -> Column:
    """The last word of the part before a comma, or of the whole name, in lower case."""
    part = F.when(F.contains(author, F.lit(",")), F.substring_index(author, ",", 1)).otherwise(author)
    return F.element_at(F.split(F.trim(F.lower(part)), r"\s+"), -1)


def authors_overlap(a: Column, b: Column) -> Column:
    """Whether two author lists share a family name: NULL if one is empty, false if the first authors differ."""
    names = lambda x: F.filter(F.transform(x, _family), lambda n: n != "")
    na, nb = names(a), names(b)
    fa, fb = _family(F.get(a, F.lit(0))), _family(F.get(b, F.lit(0)))
    return (
        F.when((F.size(na) <= 0) | (F.size(nb) <= 0) | a.isNull() | b.isNull(), None)
        .when((fa != "") & (fb != "") & (fa != fb), False)
        .otherwise(F.arrays_overlap(na, nb))
    )


def clean_title(c: Column) -> Column:
    """Without tags, the usual character entities and marks; lower case on one line."""
    x = F.coalesce(c, F.lit(""))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    x = F.regexp_replace(F.lower(F.regexp_replace(x, "<[^>]+>", " ")), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters, by recursive longest blocks."""
    return pd.Series([0.0 if not x or not y else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def token_similarity(a: Column, b: Column, sequence: bool = True) -> Column:
    """1 for equal titles, else the larger of token overlap without stop words and (``sequence``) character similarity."""
    ca, cb = clean_title(a), clean_title(b)
    def tokens(c: Column) -> Column:
        every = F.split(c, " ")
        kept = F.filter(every, lambda w: ~w.isin(lx.TITLE_STOP_WORDS))
        return F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(every))
    overlap = jaccard(tokens(ca), tokens(cb))
    best = F.greatest(overlap, sequence_ratio(ca, cb)) if sequence else overlap
    return F.when((ca == "") | (cb == ""), 0.0).when(ca == cb, 1.0).otherwise(best)


def journal_similarity(a: Column, b: Column, sequence: bool = True) -> Column:
    ca, cb = clean_title(a), clean_title(b)
    return F.when((ca == "") | (cb == ""), 0.0).when(F.contains(ca, cb) | F.contains(cb, ca), 1.0).otherwise(token_similarity(a, b, sequence))


def status(present: Column, http: Column) -> Column:
    """How a registry answered: by its record, else by the HTTP status (NULL: no answer in time)."""
    return F.when(present, "VERIFIED").when(http == 404, "NOT_FOUND").when(http == 429, "RATE_LIMITED").when(http.isNull(), "TIMEOUT").otherwise("UNAVAILABLE")


def identity_status(retracted: Column, conflict: Column, confidence: Column, agreement: Column) -> Column:
    return (
        F.when(F.coalesce(retracted, F.lit(False)), "RETRACTED").when(F.coalesce(conflict, F.lit(False)), "IDENTITY_MISMATCH")
        .when((confidence == "HIGH") & (agreement == "HIGH"), "VERIFIED").when(confidence == "MEDIUM", "PROVISIONAL").otherwise("UNVERIFIED")
    )


def decide(df: DataFrame) -> DataFrame:
    """Confidence, agreement and status of a paper.

    Takes oa_status, cr_status, sim_oa, sim_cr (paper to registry), sim_both (registry to registry), authors_match,
    journal_match (both three-valued) and is_retracted.
    """
    sim = F.greatest("sim_oa", "sim_cr")
    a, j, oa, cr = F.col("authors_match"), F.col("journal_match"), F.col("oa_status"), F.col("cr_status")
    not_false = lambda c: F.coalesce(c, F.lit(True))
    both = (oa == "VERIFIED") & (cr == "VERIFIED")
    strong = (sim >= 0.80) & F.coalesce(a, F.lit(False)) & both
    conflict = ~not_false(a) | (~not_false(j) & ~strong) | (((oa == "VERIFIED") | (cr == "VERIFIED")) & (sim < 0.70))
    high = both & (F.col("sim_both") >= 0.85) & (sim >= 0.80) & F.coalesce(a, F.lit(False)) & F.coalesce(j, F.lit(False))
    mid = both & (sim >= 0.70) & (F.col("sim_both") >= 0.60) & not_false(a) & (not_false(j) | strong)
    calm = not_false(a) & not_false(j)
    only_oa, only_cr = (oa == "VERIFIED") & cr.isin(*UNREACHED), (cr == "VERIFIED") & oa.isin(*UNREACHED)
    split = ((oa == "VERIFIED") & (cr == "NOT_FOUND")) | ((cr == "VERIFIED") & (oa == "NOT_FOUND"))
    confidence = (
        F.when(high, "HIGH").when(mid, "MEDIUM").when(only_oa & (F.col("sim_oa") >= 0.70) & calm, "MEDIUM")
        .when(only_cr & (F.col("sim_cr") >= 0.70) & calm, "MEDIUM").when(split & (sim >= 0.70) & calm, "MEDIUM").otherwise("LOW")
    )
    agreement = (
        F.when(high, "HIGH").when(mid, "MODERATE").when(both, "MISMATCH").when(only_oa, "SINGLE_SOURCE (Crossref unavailable)")
        .when(only_cr, "SINGLE_SOURCE (OpenAlex unavailable)").when(split, "SINGLE_SOURCE (Registry discrepancy)")
        .when((oa == "NOT_FOUND") & (cr == "NOT_FOUND"), "NOT_FOUND").otherwise("UNAVAILABLE")
    )
    out = df.withColumn("title_similarity", F.round(sim, 3)).withColumn("identity_conflict", conflict).withColumn("confidence", confidence).withColumn("agreement", agreement)
    return out.withColumn("identity_status", identity_status(F.col("is_retracted"), F.col("identity_conflict"), F.col("confidence"), F.col("agreement")))


def with_exits(df: DataFrame) -> DataFrame:
    """``decide`` with the cases that are settled before registries are compared; takes url, doi and venue as well.

    A preprint server's paper is MEDIUM, one without DOI is LOW, one that a registry calls retracted gets a warning instead of a confidence.
    """
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    preprint = F.contains(text("url"), F.lit("arxiv.org")) | F.contains(text("doi"), F.lit("arxiv")) | F.contains(text("venue"), F.lit("arxiv"))
    no_doi = F.trim(text("doi")) == ""
    warned = F.coalesce("is_retracted", F.lit(False)) & ~preprint & ~no_doi
    out = decide(df)
    confidence = F.when(preprint, "MEDIUM").when(no_doi, "LOW").when(warned, "RETRACTED_WARNING").otherwise(F.col("confidence"))
    agreement = F.when(preprint, "N/A (Preprint)").when(no_doi | warned, "").otherwise(F.col("agreement"))
    status = lambda c: F.when(preprint, "SKIPPED (Preprint)").when(no_doi, "SKIPPED").otherwise(F.col(c))
    settled = preprint | no_doi
    return out.withColumns({
        "oa_status": status("oa_status"), "cr_status": status("cr_status"), "confidence": confidence, "agreement": agreement,
        "identity_status": identity_status(F.col("is_retracted") & ~settled, F.col("identity_conflict") & ~settled & ~warned, confidence, agreement),
    })
