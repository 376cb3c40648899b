"""Finding the passage of a source that speaks most of a claim."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from attesta.functions import lexicon as lx
from attesta.functions.text import keywords, latin_terms, let, sentences, windows
from attesta.operators.durable import durable
from attesta.sources.providers import hash_embedder

K1, B = 1.5, 0.75


def prefilter(claims: DataFrame, sources: DataFrame, scope: list[str], least: int = 2) -> DataFrame:
    """``(scope, claim_id, source_id)`` where the source's title and content have at least ``least`` of the claim's keywords (or all).

    An equi-join on the keywords: pairs without a common word never meet.
    """
    c = claims.select(*scope, "claim_id", keywords(F.col("claim")).alias("k"))
    c = c.select(*scope, "claim_id", F.least(F.lit(least), F.size("k")).alias("need"), F.explode("k").alias("w"))
    s = sources.select(*scope, "source_id", F.explode(keywords(F.concat_ws(". ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))).alias("w"))
    met = c.join(s, [*scope, "w"]).groupBy(*scope, "claim_id", "source_id", "need").agg(F.count("*").alias("hits"))
    return met.where("hits >= need").select(*scope, "claim_id", "source_id")


def query_terms(claim: Column) -> Column:
    """A claim's terms in order, without stop words unless nothing else is left."""
    every = latin_terms(claim, 2, "a-z0-9")
    kept = F.filter(every, lambda w: ~w.isin(lx.CLAIM_STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def best_passages(pairs: DataFrame, claims: DataFrame, sources: DataFrame, most: int = 500) -> DataFrame:
    """``(claim_id, source_id, window, passage, score)``: the two-sentence window of each source that BM25 ranks first for the claim.

    The corpus of a source is its own windows. Of equal scores the first window wins; pairs without a common term
    are left out. Sources are split and counted once, however many claims they meet and in however many scopes they stand.
    """
    sources = sources.select("source_id", "content").dropDuplicates(["source_id"])
    terms_of = F.transform(windows(F.col("content")), lambda p: latin_terms(p, 2, "a-z0-9"))
    # from here to the join with the claims everything stays where the source is
    base = sources.select("source_id", terms_of.alias("t"))
    base = base.select("source_id", F.size("t").alias("n"), F.aggregate("t", F.lit(0), lambda a, x: a + F.size(x)).alias("total"), F.posexplode("t").alias("window", "x"))
    each = base.select("source_id", "n", "total", "window", F.size("x").alias("dl"), F.explode("x").alias("w"))
    tf = each.groupBy("source_id", "n", "total", "window", "dl", "w").agg(F.count("*").alias("tf"))
    tf = tf.withColumn("df", F.count("*").over(W.partitionBy("source_id", "w")))
    q = claims.select("claim_id", F.explode(query_terms(F.col("claim"))).alias("w")).groupBy("claim_id", "w").agg(F.count("*").alias("times"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (F.col("total") / F.col("n"))))
    scored = (
        pairs.select("claim_id", "source_id").join(q, "claim_id").join(tf, ["source_id", "w"])
        .groupBy("claim_id", "source_id", "window").agg(F.round(F.sum(weight), 6).alias("score"))
    )
    best = scored.groupBy("claim_id", "source_id").agg(F.max(F.struct("score", (-F.col("window")).alias("w"))).alias("b"))
    best = best.select("claim_id", "source_id", (-F.col("b.w")).alias("window"), F.col("b.score").alias("score")).where("score > 0")
    cut = let(F.get(windows(F.col("content")), F.col("window")), lambda p: F.when(F.length(p) > most, F.concat(F.substring(p, 1, most), F.lit("..."))).otherwise(p))
    return best.join(sources, "source_id").select("claim_id", "source_id", "window", cut.alias("passage"), "score")


def semantic_passages(pairs: DataFrame, claims: DataFrame, sources: DataFrame, embed: Callable[[list[str]], list[list[float]]] = hash_embedder, least: float = 0.40, most: int = 500) -> DataFrame:
    """``(claim_id, source_id, window, passage, score)``: the window of each source whose vector is nearest the claim's, if it reaches ``least``.

    Each distinct text is embedded once. Of equally near windows the first counts. Sources without text and blank claims give nothing.
    """
    w = sources.select("source_id", "content").dropDuplicates(["source_id"]).join(pairs.select("source_id").distinct(), "source_id", "left_semi")
    w = w.select("source_id", F.posexplode(windows(F.coalesce("content", F.lit("")))).alias("window", "text"))
    c = claims.join(pairs.select("claim_id").distinct(), "claim_id", "left_semi").select("claim_id", F.col("claim").alias("text")).where("trim(coalesce(text, '')) <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"text": pdf["text"], "v": embed(list(pdf["text"]))})

    v = durable(w.select("text").unionByName(c.select("text")).distinct().mapInPandas(run, "text string, v array<double>"))
    near = pairs.select("claim_id", "source_id").join(c.join(v, "text").select("claim_id", F.col("v").alias("a")), "claim_id").join(w.join(v, "text").select("source_id", "window", "text", F.col("v").alias("b")), "source_id")
    near = near.withColumn("score", F.round(F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 6))
    best = near.groupBy("claim_id", "source_id").agg(F.max(F.struct("score", (-F.col("window")).alias("w"), "text")).alias("m")).where(F.col("m.score") >= least)
    cut = F.when(F.length("m.text") > most, F.concat(F.substring("m.text", 1, most), F.lit("..."))).otherwise(F.col("m.text"))
    return best.select("claim_id", "source_id", (-F.col("m.w")).alias("window"), cut.alias("passage"), F.col("m.score").alias("score"))


def cascade(pairs: DataFrame, claims: DataFrame, sources: DataFrame, scope: list[str], embed: Callable[[list[str]], list[list[float]]] | None = hash_embedder, least: float = 0.40) -> DataFrame:
    """``(claim_id, source_id, window, passage, score, method)``: the passage by BM25 where claim and source share words, else by meaning, else none.

    ``pairs`` are the claims and sources to look at; ``embed`` None leaves out the search by meaning. Pairs without a passage are not in the result.
    """
    lexical = prefilter(claims, sources, scope).select("claim_id", "source_id").join(pairs.select("claim_id", "source_id"), ["claim_id", "source_id"], "left_semi")
    words = durable(best_passages(lexical, claims, sources))
    out = words.withColumn("method", F.lit("bm25"))
    if embed is None:
        return out
    rest = pairs.select("claim_id", "source_id").join(words.select("claim_id", "source_id"), ["claim_id", "source_id"], "left_anti")
    return out.unionByName(semantic_passages(rest, claims, sources, embed, least).where("score > 0").withColumn("method", F.lit("semantic")))


def best_by_words(pairs: DataFrame, claims: DataFrame, sources: DataFrame, most: int = 500) -> DataFrame:
    """``(claim_id, source_id, passage)``: the first sentence of each source with the most of the claim's keywords; used where ranking is not to be had."""
    s = sources.select("source_id", F.posexplode(sentences(F.coalesce("content", F.lit("")))).alias("n", "text"))
    x = pairs.select("claim_id", "source_id").join(claims.select("claim_id", keywords(F.col("claim")).alias("k")), "claim_id").join(s, "source_id")
    hits = F.size(F.array_intersect("k", F.array_distinct(latin_terms(F.col("text"), 3))))
    best = x.groupBy("claim_id", "source_id").agg(F.max(F.struct(hits.alias("hits"), (-F.col("n")).alias("n"), "text")).alias("m"))
    return best.select("claim_id", "source_id", F.when(F.length("m.text") > most, F.concat(F.substring("m.text", 1, most), F.lit("..."))).otherwise(F.col("m.text")).alias("passage"))


#: Vectors of one block; a product of two blocks is a matrix of at most BLOCK x BLOCK numbers.
BLOCK = 4096


def nearest(queries: DataFrame, corpus: DataFrame, least: float = 0.40) -> DataFrame:
    """``(query_id, vec_id, similarity)``: the other corpus vector with the largest dot product for each query, if it reaches ``least``.

    Vectors are taken as normalised; of equal ones the smallest id wins. Queries and corpus are cut into blocks of bounded size by a
    hash of their ids, each task multiplies one block of queries with one block of the corpus, and only the best of a query in a block goes on.
    Rows without a vector take no part.
    """
    q = queries.where("query_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("query_id").cast("bigint").alias("id"), "embedding")
    c = corpus.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("bigint").alias("id"), "embedding")
    nq, nc = (max(1, -(-2 * df.count() // BLOCK)) for df in (q, c))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("id", "embedding", block(nq).alias("qb"), every(nc).alias("cb"))
    right = c.select("id", "embedding", every(nq).alias("qb"), block(nc).alias("cb"))

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []}).astype({"query_id": "int64", "vec_id": "int64"})
        b = b.sort_values("id", kind="stable")
        x, y = (np.array(df["embedding"].tolist(), dtype="float64") for df in (a, b))
        s = np.round(x @ y.T, 6)
        ids = b["id"].to_numpy()
        s[a["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
        at = s.argmax(1)
        return pd.DataFrame({"query_id": a["id"].to_numpy(), "vec_id": ids[at], "similarity": s[np.arange(len(at)), at]})

    best = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(product, "query_id bigint, vec_id bigint, similarity double")
    top = best.where(F.col("similarity") >= least).groupBy("query_id").agg(F.max(F.struct("similarity", (-F.col("vec_id")).alias("v"))).alias("m"))
    return top.select("query_id", (-F.col("m.v")).alias("vec_id"), F.col("m.similarity").alias("similarity"))
