"""The loop over research rounds: at most two, and only while something new comes in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import strip
from attesta.operators.durable import durable
from attesta.operators.ordered import first_wins

ROUNDS = 2
CAP = 12


def merged(old: DataFrame | None, new: DataFrame, cap: int = CAP) -> DataFrame:
    """Sources of all rounds, the first of each address, at most ``cap`` a run; ``round`` and ``pos`` give the order."""
    both = new if old is None else old.unionByName(new)
    keyed = both.withColumn("__u", F.lower(strip(F.coalesce("url", F.lit("")))))
    return first_wins(first_wins(keyed, ["run_id", "__u"], ["round", "pos"]), ["run_id"], ["round", "pos"], cap).drop("__u")


def research(collect: Callable[[int], DataFrame], wants_more: Callable[[DataFrame], bool], rounds: int = ROUNDS) -> tuple[DataFrame, int]:
    """Sources after the last round, and how many rounds there were.

    ``collect`` gives the sources of a round (run_id, pos, url and more), ``wants_more`` judges what there is. Each round's result is
    written before the next, so that nothing is fetched twice.
    """
    have: DataFrame | None = None
    for n in range(1, rounds + 1):
        before = 0 if have is None else have.count()
        have = durable(merged(have, collect(n).withColumn("round", F.lit(n))))
        if have.count() == before or n == rounds or not wants_more(have):
            return have, n
    return have, rounds
