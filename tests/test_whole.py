import random
import re

import pytest
from pyspark.sql import functions as F

from attesta.functions.identity import literature_doi
from attesta.functions.text import jaccard, keywords, words
from attesta.operators.ordered import greedy_first_wins, like_any
from attesta.plans import core
from attesta.sources.tables import table

D = "/root/testdata/sf0.001"


def test_every_claim_of_a_run_meets_every_source(spark):
    e = core._run_evidence(spark, D).where("claim <> ''").groupBy("run_id", "claim").agg(F.min("item_id").alias("claim_id"))
    c = e.select("run_id", "claim_id", keywords(F.col("claim")).alias("k")).collect()
    text = F.concat_ws(". ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    s = core._run_sources(spark, D).select("run_id", "source_id", keywords(text).alias("k")).collect()
    hits = lambda x, y: len(set(x.k) & set(y.k))
    want = sorted((x.claim_id, y.source_id) for x in c for y in s if x.run_id == y.run_id and x.k and hits(x, y) >= min(2, len(x.k)))
    assert sorted(tuple(r) for r in core.c_prefilter(spark, D).collect()) == want
    met = {r.claim_id for r in core.c_best_passages(spark, D).select("claim_id").collect()}
    assert len(c) > 3 * len({x.run_id for x in c}) and len(met) > 3 * len({x.run_id for x in c})


def test_every_titled_source_is_a_proposal(spark):
    x = table(spark, D, "academic_sources").where("title <> ''")
    p = x.where("size(filter(split(trim(coalesce(content, '')), '\\\\s+'), w -> w <> '')) >= 8").select("run_id", "rec_id", "pos", words(F.concat(F.lit("extending "), F.col("title"))).alias("a"))
    like = p.join(x.select("run_id", words(F.col("title")).alias("b")), "run_id").where(jaccard(F.col("a"), F.col("b")) > 0.65)
    want = {r.rec_id: r.pos for r in p.join(like.select("rec_id"), "rec_id", "left_anti").collect()}
    assert {r.rec_id for r in core.j_valid_gaps(spark, D).collect()} == set(want)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_like_any_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = lambda: [(rnd.choice("xy"), sorted(rnd.sample("abcdefgh", rnd.randint(0, 6)))) for _ in range(60)]
    a, b = rows(), rows()
    frame = lambda r: spark.createDataFrame(r, "k string, t array<string>")
    got = {(r.k, tuple(r.t)) for r in like_any(frame(a), frame(b), ["k"], "t", 0.65).collect()}
    assert got == {(k, tuple(t)) for k, t in a for n, u in b if k == n and t and u and len({*t} & {*u}) / len({*t} | {*u}) > 0.65} and got


def test_every_doi_of_evidence_is_looked_up(spark):
    e = core._run_evidence(spark, D).select("run_id", "evidence", "doi").collect()
    have = {(r.run_id, r.k) for r in core._run_sources(spark, D).where("doi <> ''").select("run_id", literature_doi(F.col("doi")).alias("k")).collect()}
    form = lambda x: x.strip().rstrip(".,;:)\"'").lower()
    named = {(r.run_id, form(m)) for r in e for m in re.findall(r"(?i)10\.[0-9]{4,9}/[^\s\"<>()\[\]]+", f"{r.evidence or ''} see {r.doi or ''}.")}
    got = [(r.run_id, r.doi) for r in core.j_invented_dois(spark, D).collect()]
    assert sorted(got) == sorted(named - have) and got


def test_a_long_chain_of_likes_is_decided_to_its_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(110)], "earlier bigint, later bigint").coalesce(1)
    kept = greedy_first_wins(spark.range(0, 111, 1, 1).withColumnRenamed("id", "n"), "n", edges)
    assert sorted(r.n for r in kept.collect()) == list(range(0, 111, 2))
