"""Labels of claim-passage pairs: reading them, counting them, and a rule that gives them where no model is at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import keywords

LABELS = ("ENTAILMENT", "NEUTRAL", "CONTRADICTION", "UNVERIFIED")
# The order in which the public classifier numbers its labels, and words that negate.
BY_NUMBER = {"LABEL_0": "CONTRADICTION", "LABEL_1": "ENTAILMENT", "LABEL_2": "NEUTRAL"}
NEGATIONS = ("not", "no", "never", "neither", "without", "nor", "cannot", "failed", "fails")


def interpret(scores: Column, threshold: float) -> Column:
    """Label and score of a model's output ``array<struct<label,score>>``: the best label, NEUTRAL if it is unknown or too weak."""
    best = F.get(F.array_sort(scores, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)), F.lit(0))
    raw = F.upper(best["label"])
    label = F.when(raw.isin(*LABELS[:3]), raw)
    for k, v in BY_NUMBER.items():
        label = F.coalesce(label, F.when(raw == k, F.lit(v)))
    label = F.coalesce(label, F.lit("NEUTRAL"))
    return F.struct(F.when((label != "NEUTRAL") & (best["score"] < threshold), F.lit("NEUTRAL")).otherwise(label).alias("label"), best["score"].alias("score"))


def rule_label(claim: Column, passage: Column, threshold: float = 0.70) -> Column:
    """Stand-in for a model: the share of the claim's keywords in the passage, contradicted if only one of them negates.

    Blank sides are UNVERIFIED; what is below the threshold is NEUTRAL with its score kept.
    """
    k = keywords(claim)
    score = F.round(F.size(F.array_intersect(k, keywords(passage))) / F.greatest(F.size(k), F.lit(1)), 3)
    negated = lambda c: F.arrays_overlap(F.split(F.lower(c), "[^a-z]+"), F.array(*map(F.lit, NEGATIONS)))
    side = F.when(negated(claim) != negated(passage), "CONTRADICTION").otherwise("ENTAILMENT")
    blank = (F.trim(F.coalesce(claim, F.lit(""))) == "") | (F.trim(F.coalesce(passage, F.lit(""))) == "")
    label = F.when(blank, "UNVERIFIED").when(score < threshold, "NEUTRAL").otherwise(side)
    return F.struct(label.alias("label"), F.when(~blank, score).alias("score"))


def summary(df: DataFrame) -> DataFrame:
    """One row: how many of each label, and rates over the checked ones; NULL where nothing was checked."""
    up = F.upper(F.coalesce("label", F.lit("UNVERIFIED")))
    n = {x: F.count_if(up == x) for x in LABELS}
    checked = n["ENTAILMENT"] + n["NEUTRAL"] + n["CONTRADICTION"]
    rate = lambda c: F.round(c / F.when(checked > 0, checked), 3)
    return df.agg(
        F.count("*").alias("total"), n["ENTAILMENT"].alias("entailed"), n["NEUTRAL"].alias("neutral"), n["CONTRADICTION"].alias("contradicted"),
        (F.count("*") - checked).alias("unverified"), rate(n["ENTAILMENT"]).alias("entailment_rate"), rate(n["CONTRADICTION"]).alias("contradiction_rate"),
        rate(n["NEUTRAL"] + n["CONTRADICTION"]).alias("unsupported_or_contradicted_rate"),
    )
