"""Mixing sources to target shares of the total size.

Sizes are tokens of a public tokenizer. The mix is as large as the caps allow: no source may be repeated more often
than its cap, so the scarcest source sets the total. The total is cut into equal blocks that Sainte-Laguë's method
hands to the sources by highest quotients, and each source's blocks to its shards the same way. Within a shard the
documents lie in blocks of one size, blocks are taken in a seeded order, whole passes first, and the last pass stops
at the document that fills the quota.

Defined cases
    Documents with NULL or empty text have no tokens and are never taken. Sources without a target, and NULL sources,
    are not mixed. Targets without documents are reported with an actual share of 0, and the other targets are scaled
    to sum to 1. Targets that are NULL or not positive count as 0, a NULL cap as 1. Empty tables give an empty mix.
    A source named twice in the targets counts with its largest share. The same seed gives the same mix.

Bounds
    The targets are a table of settings: at most ``MOST_SOURCES`` rows are accepted. Shards hold about
    ``SHARD_DOCS`` documents each, and at most ``MOST_SHARDS`` exist at once, so what the driver handles is bounded.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from attesta.llm.bpe import token_count
from attesta.operators.durable import durable
from attesta.operators.spread import spread

MOST_SOURCES = 10_000
SHARD_DOCS = 50_000
MOST_SHARDS = 20_000
BLOCKS = 20_000
#: At least so many blocks for each shard, so that a shard's whole number of blocks is near its part.
SHARD_BLOCKS = 64


def sainte_lague(weights: Sequence[float], seats: int, limits: Sequence[int] | None = None) -> list[int]:
    """``seats`` handed out by the highest quotients weight / (2 k + 1); ties go to the earlier one; ``limits`` are never exceeded."""
    got = [0] * len(weights)
    limits = list(limits) if limits is not None else [seats] * len(weights)
    total = sum(w for w in weights if w > 0)
    if total <= 0:
        return got
    # every one surely has what its share, less one half for each competitor's rounding, comes to; the rest by quotients
    live = sum(w > 0 for w in weights)
    for i, w in enumerate(weights):
        got[i] = max(0, min(limits[i], int(seats * w / total) - live)) if w > 0 else 0
    heap = [(-w / (2 * got[i] + 1), i) for i, w in enumerate(weights) if w > 0 and got[i] < limits[i]]
    heapq.heapify(heap)
    left = seats - sum(got)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < limits[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, tokens)`` of the documents that have tokens."""
    return durable(spread(docs.select("doc_id", "source", "text")).select("doc_id", "source", token_count(F.col("text")).alias("tokens")).where("tokens > 0"))


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 7, blocks: int = BLOCKS) -> DataFrame:
    """``(doc_id, source, tokens, copies)``: the documents of the mix and how often each is used."""
    spark = sizes.sparkSession
    t = targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    rows = t.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    want = {r["source"]: (float(r["share"]), int(r["cap"])) for r in rows if r["cap"] > 0}
    schema = "doc_id bigint, source string, tokens bigint, copies int"
    mixed = sizes.where(F.col("source").isin(list(want)))
    per = {r["source"]: r for r in mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    names = sorted(s for s in want if s in per)
    if not names:
        return spark.createDataFrame([], schema)
    shares = [want[s][0] for s in names]
    total = min(per[s]["tokens"] * want[s][1] / (want[s][0] / sum(shares)) for s in names)
    every = sum(per[s]["docs"] for s in names)
    size = max(SHARD_DOCS, -(-every // MOST_SHARDS) + 1)
    shards = {s: max(1, -(-per[s]["docs"] // size)) for s in names}
    blocks = max(blocks, SHARD_BLOCKS * sum(shards.values()))
    seats = sainte_lague(shares, blocks)
    of_source = F.create_map(*[F.lit(x) for s in names for x in (s, shards[s])])
    placed = mixed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.element_at(of_source, F.col("source"))).cast("int"))
    held: dict[str, list] = {s: [] for s in names}
    for r in placed.groupBy("source", "shard").agg(F.sum("tokens").alias("held")).orderBy("source", "shard").collect():
        held[r["source"]].append((r["shard"], r["held"]))
    quota: list[tuple] = []
    one = total / blocks
    for s, k in zip(names, seats):
        tokens, cap = [h for _, h in held[s]], want[s][1]
        # whole blocks for each shard; a shard that can't fill its last block gives what it has
        for (shard, h), q in zip(held[s], sainte_lague(tokens, k, [int(-(-h * cap // one)) for h in tokens])):
            quota.append((s, shard, min(q * one, float(h * cap)), float(h), cap))
    plan = spark.createDataFrame(quota, "source string, shard int, quota double, held double, cap int")
    w = W.partitionBy("source", "shard")
    seeded = placed.withColumn("h", F.xxhash64(F.lit(seed + 1), "doc_id"))
    lying = seeded.withColumn("lies", F.sum("tokens").over(w.orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)))
    block = F.floor(F.coalesce("lies", F.lit(0)) / F.lit(one))
    turned = lying.withColumn("turn", F.xxhash64(F.lit(seed + 2), "source", "shard", block)).withColumn(
        "before", F.coalesce(F.sum("tokens").over(w.orderBy("turn", "h", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    passes = F.floor(F.col("quota") / F.col("held"))
    rest = F.col("quota") - passes * F.col("held")
    copies = F.least(F.col("cap"), passes + F.when(F.col("before") + F.col("tokens") / 2 <= rest, 1).otherwise(0)).cast("int")
    return turned.join(F.broadcast(plan), ["source", "shard"]).select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, actual_share, tokens, docs, most_copies)``: what each target source really contributes."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("docs"), F.max("copies").alias("most_copies"))
    t = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"))
    j = t.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    j = j.crossJoin(F.broadcast(j.agg(F.sum("tokens").alias("__whole"))))  # one row
    whole = F.col("__whole")
    return j.select(
        "source", "target_share", F.when(whole > 0, F.round(F.col("tokens") / whole, 6)).otherwise(0.0).alias("actual_share"),
        "tokens", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
