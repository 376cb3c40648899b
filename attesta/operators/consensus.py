"""What the literature says of a claim: support, contradiction and retractions across independent sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import lexicon as lx
from attesta.functions.identity import canonical_id, source_key
from attesta.functions.text import latin_terms, strip, words
from attesta.operators.durable import durable
from attesta.operators.lookup import last_label
from attesta.operators.ordered import alike_first_wins, first_wins, greedy_first_wins
from attesta.operators.retrieval import best_passages, prefilter
from attesta.operators.verdicts import rule_label


def is_relevant(claim: Column, topic: Column | None = None) -> Column:
    """No words of shops; if there is a topic, one of its words or one of research."""
    ok = (F.coalesce(claim, F.lit("")) != "") & ~claim.rlike("(?i)" + lx.COMMERCE)
    if topic is None:
        return ok
    own = lambda c: F.array_except(latin_terms(c, 2, "a-z0-9"), F.array(*map(F.lit, lx.CLAIM_STOP_WORDS)))
    t, c = own(topic), own(claim)
    return ok & ((F.size(t) == 0) | F.arrays_overlap(c, t) | F.arrays_overlap(c, F.array(*map(F.lit, lx.RESEARCH_WORDS))))


def core_claims(evidence: DataFrame, verdicts: DataFrame, most: int = 5, alike: float = 0.70) -> DataFrame:
    """The first ``most`` claims of each run that are entailed, relevant and not like an earlier kept one.

    ``evidence`` has run_id, item_id, claim and the keys of its verdicts; item_id and verdict_id give the order.
    """
    labelled = last_label(evidence, verdicts, "verdict_id")
    good = labelled.where((F.col("label") == "ENTAILMENT") & (strip(F.coalesce("claim", F.lit(""))) != "") & is_relevant(F.col("claim")))
    kept = alike_first_wins(durable(good.withColumn("__w", words(F.col("claim")))), ["run_id"], "item_id", "__w", alike)
    return first_wins(kept, ["run_id"], ["item_id"], most).drop("__w")


def independent_sources(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """``(run_id, claim_id, source_id)``: for each claim the sources of its run that are not its own nor like an earlier one."""
    s = sources.select("run_id", "source_id", "pos", canonical_id(F.col("doi"), F.col("url"), F.col("title")).alias("cid"), source_key(F.col("doi"), F.col("url"), F.col("title")).alias("skey"))
    c = claims.select("run_id", "claim_id", F.col("cid").alias("own_cid"), F.col("skey").alias("own_skey"))
    own = (F.coalesce(F.col("cid") == F.col("own_cid"), F.lit(False))) | ((F.col("own_skey") != "") & F.coalesce(F.col("skey") == F.col("own_skey"), F.lit(False)))
    pairs = c.join(s, "run_id").where(~own).select("run_id", "claim_id", "source_id", "pos", "cid", "skey")
    pairs = durable(pairs.withColumn("pid", F.struct("claim_id", "pos", "source_id")))
    # the usual case, rows alike in both keys, is settled by an aggregate; the rest by rounds
    firsts = durable(first_wins(pairs, ["claim_id", "cid", "skey"], ["pos", "source_id"]))
    edges = None
    for key in ("cid", "skey"):
        k = firsts.where(F.coalesce(F.col(key), F.lit("")) != "").select("claim_id", key, "pid")
        e = k.select("claim_id", key, F.col("pid").alias("earlier")).join(k.select("claim_id", key, F.col("pid").alias("later")), ["claim_id", key]).where("earlier < later").select("earlier", "later")
        edges = e if edges is None else edges.unionByName(e)
    return greedy_first_wins(firsts, "pid", edges).select("run_id", "claim_id", "source_id")


def assess(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """``(claim_id, source_id, passage, score, label, is_retracted)`` of the independent sources that speak of a claim."""
    free = independent_sources(claims, sources)
    with_text = sources.where(strip(F.coalesce("content", F.lit(""))) != "")
    near = durable(prefilter(claims, with_text, ["run_id"]).join(free, ["run_id", "claim_id", "source_id"]))
    best = best_passages(near, claims, with_text)
    retracted = sources.groupBy("source_id").agg(F.coalesce(F.bool_or("is_retracted"), F.lit(False)).alias("is_retracted"))
    j = best.join(claims.select("claim_id", "claim"), "claim_id").join(retracted, "source_id")
    return j.withColumn("v", rule_label(F.col("claim"), F.col("passage"))).select("claim_id", "source_id", "passage", "score", F.col("v.label").alias("label"), "is_retracted")


def verdict(support: Column, independent: Column, against: Column) -> Column:
    return (
        F.when((independent >= 1) & (against == 0) & (support >= 2), "CONSISTENT_SUPPORT").when((support >= 1) & (against >= 1), "MIXED_EVIDENCE")
        .when((against >= 1) & (support == 0), "PREDOMINANTLY_CONTRADICTED").when((support == 1) & (against == 0), "SINGLE_SOURCE_CLAIM").otherwise("UNADDRESSED")
    )


def verdict_reason(support: Column, independent: Column, against: Column, origin: Column) -> Column:
    """One sentence that says why."""
    n = lambda c: c.cast("string")
    v = verdict(support, independent, against)
    return (
        F.when((v == "CONSISTENT_SUPPORT") & (origin >= 1), F.concat(F.lit("Supported by originating paper and corroborated by "), n(independent), F.lit(" independent academic source(s) with zero contradictory findings.")))
        .when(v == "CONSISTENT_SUPPORT", F.concat(F.lit("Supported by "), n(independent), F.lit(" independent academic source(s) with zero contradictory findings.")))
        .when(v == "MIXED_EVIDENCE", F.concat(F.lit("Conflicting findings observed across literature: "), n(support), F.lit(" supporting ("), n(independent), F.lit(" independent) vs "), n(against), F.lit(" contradicting source(s).")))
        .when(v == "PREDOMINANTLY_CONTRADICTED", F.concat(F.lit("Literature contradicts this claim ("), n(against), F.lit(" contradictory finding(s), "), n(against), F.lit(" independent).")))
        .when((v == "SINGLE_SOURCE_CLAIM") & (origin >= 1), "Supported by originating paper, but not corroborated or tested across other retrieved sources.")
        .when(v == "SINGLE_SOURCE_CLAIM", "Supported by a single literature source, without independent corroboration.")
        .otherwise("No authoritative evidence found across the retrieved literature.")
    )


def profiles(claims: DataFrame, assessed: DataFrame) -> DataFrame:
    """One row a claim: counts, verdict and reason. A retracted source is an alert and never counted."""
    each = assessed.groupBy("claim_id").agg(
        F.count_if((F.col("label") == "ENTAILMENT") & ~F.col("is_retracted")).alias("ind"),
        F.count_if((F.col("label") == "CONTRADICTION") & ~F.col("is_retracted")).alias("con"),
        F.count_if(F.col("is_retracted")).alias("ret"),
    )
    j = claims.join(each, "claim_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    has = strip(F.coalesce("evidence", F.lit(""))) != ""
    origin = F.when(has & ~F.col("is_retracted"), 1).otherwise(0).cast("bigint")
    j = j.withColumn("independent", zero("ind")).withColumn("contradicting", zero("con")).withColumn("origin", origin)
    j = j.withColumn("supporting", F.col("origin") + F.col("independent")).withColumn("alerts", zero("ret") + F.when(has & F.col("is_retracted"), 1).otherwise(0))
    cols = (F.col("supporting"), F.col("independent"), F.col("contradicting"))
    return j.select("run_id", "claim_id", "claim", *[c for c in ("supporting", "independent", "contradicting", "alerts")], verdict(*cols).alias("verdict"), verdict_reason(*cols, F.col("origin")).alias("reason"))
