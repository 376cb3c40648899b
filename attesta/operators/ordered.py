"""Deduplication in which the first row wins, by an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from attesta.operators.durable import durable


def first_wins(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str], most: int = 1) -> DataFrame:
    """The first ``most`` rows of each key; NULL is a key like any other. The limit is applied before the shuffle, too."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most).drop("__rn")


def first_wins_if_given(df: DataFrame, key: Column, scope: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key within its scope, and every row without a key ('' or NULL)."""
    k = F.when(key != "", key)
    x = df.withColumn("__k", k)
    none = x.where("__k IS NULL").drop("__k")
    return none.unionByName(first_wins(x.where("__k IS NOT NULL"), [*scope, "__k"], order).drop("__k"))


def similar_pairs(df: DataFrame, scope: Sequence[str], id_col: str, tokens: str, threshold: float) -> DataFrame:
    """``(earlier, later)`` ids of rows of one scope whose token sets have a Jaccard similarity of at least ``threshold``.

    Rows meet on the rarest tokens of their sets only: two sets that similar share one of them (prefix filter).
    """
    base = df.select(*scope, F.col(id_col).alias("id"), F.array_distinct(tokens).alias("t")).where(F.size("t") > 0)
    each = base.select(*scope, "id", F.explode("t").alias("w"))
    rare = each.groupBy("w").agg(F.count("*").alias("n"))
    ranked = each.join(rare, "w").groupBy(*scope, "id").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("r"))
    n = F.size("r")
    prefix = ranked.select(*scope, "id", F.transform("r", lambda x: x["w"]).alias("t"), F.explode(F.slice(F.transform("r", lambda x: x["w"]), F.lit(1), n - F.ceil(n * threshold - 1e-9).cast("int") + 1)).alias("w"))
    a, b = prefix.select(*scope, "w", F.col("id").alias("earlier"), F.col("t").alias("ta")), prefix.select(*scope, "w", F.col("id").alias("later"), F.col("t").alias("tb"))
    met = a.join(b, [*scope, "w"]).where("earlier < later").select("earlier", "later", "ta", "tb").dropDuplicates(["earlier", "later"])
    both = F.size(F.array_intersect("ta", "tb"))
    return met.where(both >= threshold * (F.size("ta") + F.size("tb") - both) - 1e-9).select("earlier", "later")


def like_any(left: DataFrame, right: DataFrame, scope: Sequence[str], tokens: str, threshold: float) -> DataFrame:
    """The ``(scope, tokens)`` of ``left`` whose Jaccard similarity to a token set of ``right`` in the same scope is above ``threshold``.

    Tokens are sets. Equal sets of a scope are compared once, and only those meet that share a token of both prefixes (see ``similar_pairs``).
    """
    sides = {n: durable(df.select(*scope, F.array_sort(tokens).alias(n)).where(F.size(n) > 0).distinct()) for n, df in (("a", left), ("b", right))}
    each = {n: df.select(*scope, n, F.explode(n).alias("w")) for n, df in sides.items()}
    rare = durable(each["a"].select("w").unionByName(each["b"].select("w")).groupBy("w").agg(F.count("*").alias("n")))

    def prefix(n: str) -> DataFrame:
        r = each[n].join(rare, "w").groupBy(*scope, n).agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("r"))
        return r.select(*scope, n, F.explode(F.slice(F.transform("r", lambda x: x["w"]), F.lit(1), F.size("r") - F.ceil(F.size("r") * threshold - 1e-9).cast("int") + 1)).alias("w"))

    met = prefix("a").join(prefix("b"), [*scope, "w"])
    both = F.size(F.array_intersect("a", "b"))
    return met.where(both / (F.size("a") + F.size("b") - both) > threshold).select(*scope, F.col("a").alias(tokens)).distinct()


def greedy_first_wins(df: DataFrame, id_col: str, edges: DataFrame) -> DataFrame:
    """The rows that a pass in id order keeps if a row is dropped for being like a kept earlier one.

    ``edges`` holds ``(earlier, later)``. Each round decides every row whose earlier neighbours are decided, so the
    number of rounds is the longest chain of likes, not the number of rows. Each round decides a row, so it ends.
    """
    open_edges = durable(edges.distinct())
    dropped: DataFrame | None = None
    while not open_edges.isEmpty():
        later = open_edges.select(F.col("later").alias("id")).distinct()
        sure = open_edges.select(F.col("earlier").alias("id")).distinct().join(later, "id", "left_anti")
        gone = durable(open_edges.join(sure, F.col("earlier") == F.col("id"), "left_semi").select(F.col("later").alias("id")).distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        left = open_edges.join(gone, F.col("earlier") == F.col("id"), "left_anti").join(gone, F.col("later") == F.col("id"), "left_anti")
        open_edges = durable(left.join(sure, F.col("earlier") == F.col("id"), "left_anti"))
    if dropped is None:
        return df
    return df.join(dropped.distinct(), df[id_col] == F.col("id"), "left_anti")


def alike_first_wins(df: DataFrame, scope: Sequence[str], order: str, tokens: str, threshold: float) -> DataFrame:
    """The rows of each scope that a pass in ``order`` keeps if a row like a kept earlier one is dropped; rows without tokens are like no other.

    Rows with equal token sets are like the same rows, so only their first can stay; the others go before pairs are made,
    and a set that a large part of the rows has costs one aggregate. ``order`` is unique over all scopes.
    """
    x = df.withColumn("__set", F.array_sort(F.array_distinct(tokens)))
    none, some = x.where(F.size("__set") <= 0), x.where(F.size("__set") > 0)
    firsts = durable(first_wins(some, [*scope, "__set"], [order]))
    kept = greedy_first_wins(firsts, order, similar_pairs(firsts, scope, order, "__set", threshold))
    return kept.unionByName(none).drop("__set")
