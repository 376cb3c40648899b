"""Scores of finished reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import lexicon as lx
from attesta.functions.text import strip


def section_share(report: Column) -> Column:
    low = F.lower(report)
    return sum((F.contains(low, F.lit(s)).cast("int") for s in lx.SECTIONS), F.lit(0)) / F.lit(len(lx.SECTIONS))


def word_count(c: Column) -> Column:
    return F.when(strip(c) == "", 0).otherwise(F.size(F.split(strip(c), r"\s+"))).cast("bigint")


def density(items: Column, report: Column) -> Column:
    """Evidence items for each thousand words."""
    n = word_count(report)
    return F.when(n > 0, F.round(items / n * 1000, 2)).otherwise(0.0)


def diversity(web: Column, academic: Column) -> Column:
    return F.when(web + academic > 0, F.round(academic / (web + academic), 2)).otherwise(0.0)


def gap_acknowledged(report: Column) -> Column:
    """More than forty words in the 600 characters from the first mention of a knowledge gap on."""
    at = F.instr(F.lower(report), "knowledge gap")
    return (at > 0) & (word_count(F.substr(report, at, F.lit(600))) > 40)


def overall(sections: Column, coverage: Column, div: Column, dens: Column, gap: Column, judge: Column | None = None) -> Column:
    """0 to 10; 0.4 of the rules and 0.6 of the judge if there is one."""
    rule = (sections * 0.35 + coverage * 0.25 + div * 0.15 + F.least(dens / 10, F.lit(1.0)) * 0.15 + F.when(gap, 0.10).otherwise(0.0)) * 10
    return F.round(F.round(rule if judge is None else F.when(judge.isNull(), rule).otherwise(rule * 0.4 + judge * 0.6), 6) * 100) / 100


def ablation(scores: DataFrame, topic: str, mode: str, value: str) -> DataFrame:
    """One row a topic with its value in either mode."""
    return scores.groupBy(topic).pivot(mode, ["VERIFICATION_OFF", "VERIFICATION_ON"]).agg(F.round(F.avg(value), 4))


def coverage(report: Column, cited: Column, eligible: Column) -> Column:
    """The share of sentences with a citation: as a report's own audit section has it, else ``cited`` of ``eligible``; 0 if none is eligible."""
    said = lambda mark: F.regexp_extract(report, mark + r":\s*([0-9]+)", 1)
    e, c = said("Eligible factual-claim candidates"), said("Candidates with at least one registered citation")
    both = (e != "") & (c != "")
    of = F.when(both, e.cast("bigint")).otherwise(eligible)
    return F.when(of > 0, F.when(both, c.cast("bigint")).otherwise(cited) / of).otherwise(0.0)


# What a judge scores.
JUDGED = ("factual_grounding", "clarity", "depth", "critical_analysis", "recommendation_quality")


def judge_average(scores: Column) -> Column:
    """The mean of a judge's five scores in a struct; NULL unless all are whole numbers from 1 to 10."""
    each = [scores[n] for n in JUDGED]
    valid = F.lit(True)
    for c in each:
        valid = valid & F.coalesce(c.between(1, 10), F.lit(False))
    return F.when(valid, F.round(sum(each[1:], each[0]) / len(each), 2))
