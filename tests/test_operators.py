import itertools
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from attesta.functions import quotes
from attesta.functions import text as tx
from attesta.functions.identity import literature_doi, report_url
from attesta.operators import citations, consensus, lookup, ordered, registry, retrieval, scorecard, skew, trust, verdicts
from attesta.sources.cache import fresh, missing


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("url, title, content, tier", [
    ("https://cs.mit.edu/x", "", "", 1), ("https://www.nature.com/a", "", "add to cart", 1), ("https://sub.ox.ac.uk", "", "", 1), ("https://blog.org/a", "", "", 2),
    ("https://www.amazon.com/x", "", "", 3), ("https://shop.org/x", "", "Buy now!", 3), ("https://a.org/x", "Best price on lamps", "", 3), ("no address", "", "", 3), ("", "", "", 3),
    ("https://en.wikipedia.org/wiki/Bias", "", "", 3), ("https://en.wikipedia.org/wiki/Bias_(statistics)", "", "", 2), ("https://notamazon.com/", "", "", 2), ("https://xhamster.net/", "", "", 3),
])
def test_tiers(spark, url, title, content, tier):
    assert one(spark, trust.tier(F.lit(url), F.lit(title), F.lit(content))) == tier


@pytest.mark.parametrize("types, venue, url, kind", [
    (["JournalArticle"], "Workshop", "", "journal"), (["Preprint"], "", "", "preprint"), ([], "arXiv", "", "preprint"), (None, "Proceedings of X", "", "conference"), ([], "Annals", "", "journal"), ([], "", "", "report"),
])
def test_source_types(spark, types, venue, url, kind):
    assert one(spark, trust.source_type(F.lit(types).cast("array<string>"), F.lit(venue), F.lit(url))) == kind


def test_relevance_keeps_all_rows_of_a_scope_without_a_hit(spark):
    df = spark.createDataFrame([("r1", 1, "drift models", ""), ("r1", 2, "cooking", ""), ("r2", 3, "cooking", "soup"), ("r2", 4, None, None)], "run_id string, rec_id int, title string, content string")
    out = trust.relevant(df, F.lit("The drift of models"), 2, ["the", "of"], ["run_id"])
    assert sorted(r.rec_id for r in out.collect()) == [1, 3, 4]


def test_first_wins_and_blanks(spark):
    df = spark.createDataFrame([("r", 2, "doi:10.1/A"), ("r", 1, "https://doi.org/10.1/a"), ("r", 3, ""), ("r", 4, None), ("s", 1, "10.1/a.")], "run_id string, pos int, doi string")
    out = ordered.first_wins_if_given(df, literature_doi(F.col("doi")), ["run_id"], ["pos"])
    assert sorted((r.run_id, r.pos) for r in out.collect()) == [("r", 1), ("r", 3), ("r", 4), ("s", 1)]


def _greedy(rows, threshold):
    kept = []
    for i, t in rows:
        s = set(t)
        if s and any(len(s & set(k)) / len(s | set(k)) >= threshold - 1e-9 for _, k in kept if k):
            continue
        kept.append((i, t))
    return [i for i, _ in kept]


@pytest.mark.parametrize("seed", range(4))
def test_greedy_dedup_is_the_pass_in_order(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.sample("abcdefghij", rnd.randint(0, 6))) for i in range(60)]
    df = spark.createDataFrame([(g, i, t) for g in ("x", "y") for i, t in rows], "g string, i int, t array<string>").withColumn("o", F.struct("g", "i"))
    out = ordered.greedy_first_wins(df, "o", ordered.similar_pairs(df, ["g"], "o", "t", 0.6))
    assert sorted(r.i for r in out.where("g = 'x'").collect()) == _greedy(rows, 0.6)
    out = ordered.alike_first_wins(df, ["g"], "o", "t", 0.6)
    assert sorted(r.i for r in out.where("g = 'y'").collect()) == _greedy(rows, 0.6)


def test_salted_lookup_loses_and_doubles_nothing(spark):
    big = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), "id")
    small = big.groupBy("k").agg(F.count("*").alias("n"))
    out = skew.salted_lookup(big, small, "k", ["hot"], "id")
    assert out.count() == 5000 and out.select("id").distinct().count() == 5000
    assert skew.hot_keys(small, "k") == []


def _labels(spark):
    e = spark.createDataFrame([(1, "e1", "s1", "http://a/x", "A claim"), (2, "e9", "s1", "http://a/x", " a  CLAIM "), (3, None, None, None, "Other"), (4, None, "", "", None)], "item_id int, evidence_id string, source_key string, source_url string, claim string")
    v = spark.createDataFrame([
        (1, "e1", "s1", "http://a/x", "A claim", "ENTAILMENT", 0.9), (2, "e1", "s1", "http://A/x", "A claim", "neutral", 0.4), (3, "e2", "s1", "http://a/x", "a claim", "CONTRADICTION", 0.8), (4, "e3", "s3", "", "Other", "Entailment", None),
    ], "verdict_id int, evidence_id string, source_key string, source_url string, claim string, label string, confidence double")
    return e, v


def test_last_verdict_of_the_first_key_that_is_known(spark):
    e, v = _labels(spark)
    got = {r.item_id: r.label for r in lookup.last_label(e, v, "verdict_id").collect()}
    assert got == {1: "neutral", 2: "CONTRADICTION", 3: "Entailment", 4: None}


def test_differing_verdicts_are_unverified(spark):
    e, v = _labels(spark)
    got = {r.item_id: r.label for r in lookup.agreed_label(e.withColumn("label", F.lit(None).cast("string")), v, report_url).collect()}
    assert got == {1: "UNVERIFIED", 2: "UNVERIFIED", 3: "ENTAILMENT", 4: "UNVERIFIED"}


def test_interpretation_of_scores(spark):
    def read(*pairs):
        return tuple(one(spark, verdicts.interpret(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("score")) for a, b in pairs]), 0.70)))
    assert read(("entailment", 0.9), ("neutral", 0.1)) == ("ENTAILMENT", 0.9)
    assert read(("CONTRADICTION", 0.65), ("NEUTRAL", 0.2)) == ("NEUTRAL", 0.65)
    assert read(("LABEL_0", 0.8)) == ("CONTRADICTION", 0.8) and read(("odd", 0.99)) == ("NEUTRAL", 0.99)


def test_rule_labels_and_summary(spark):
    r = lambda c, p: tuple(one(spark, verdicts.rule_label(F.lit(c), F.lit(p))))
    assert r("drift lowers error", "We saw that drift lowers the error.") == ("ENTAILMENT", 1.0)
    assert r("drift lowers error", "Here drift never lowers error.") == ("CONTRADICTION", 1.0)
    assert r("drift lowers error", "cooking soup") == ("NEUTRAL", 0.0) and r("", "x") == ("UNVERIFIED", None)
    df = spark.createDataFrame([("ENTAILMENT",), ("neutral",), ("CONTRADICTION",), (None,), ("ENTAILMENT",)], "label string")
    s = verdicts.summary(df).first()
    assert (s.total, s.entailed, s.unverified, s.entailment_rate, s.unsupported_or_contradicted_rate) == (5, 2, 1, 0.5, 0.5)
    none = verdicts.summary(df.where("false")).first()
    assert none.total == 0 and none.entailment_rate is None


def _bm25(query, docs):
    import math
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {w: sum(w in d for d in docs) for w in set(itertools.chain(*docs))}
    return [sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in query if w in df) for d in docs]


def test_best_passage_is_the_first_of_the_best(spark):
    body = "Cats sleep a lot. Drift lowers error. Drift lowers error. Nothing else is said here. Dogs bark."
    claims = spark.createDataFrame([("r", 1, "Drift lowers the error"), ("r", 2, "zebra quagga")], "run_id string, claim_id int, claim string")
    sources = spark.createDataFrame([("r", 7, "T", body), ("r", 8, "T", "unrelated words only")], "run_id string, source_id int, title string, content string")
    pairs = retrieval.prefilter(claims, sources, ["run_id"])
    assert [(r.claim_id, r.source_id) for r in pairs.collect()] == [(1, 7)]
    got = retrieval.best_passages(pairs, claims, sources).collect()
    wins = ["Cats sleep a lot. Drift lowers error.", "Drift lowers error. Drift lowers error.", "Drift lowers error. Nothing else is said here.", "Nothing else is said here. Dogs bark."]
    scores = _bm25(["drift", "lowers", "error"], [[w for w in x.lower().replace(".", "").split() if len(w) > 1] for x in wins])
    assert got[0].passage == wins[1] and got[0].score == pytest.approx(scores[1], abs=1e-5) == pytest.approx(max(scores), abs=1e-5)


def test_nearest_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.8, 0.6]), (4, [-1.0, 0.0])], "vec_id int, embedding array<float>")
    q = df.where("vec_id IN (1, 4)").select(F.col("vec_id").alias("query_id"), "embedding")
    assert [tuple(r) for r in retrieval.nearest(q, df).collect()] == [(1, 2, pytest.approx(0.8, abs=1e-6))]


@pytest.mark.parametrize("sup, ind, con, expected", [
    (2, 1, 0, "CONSISTENT_SUPPORT"), (1, 0, 1, "MIXED_EVIDENCE"), (0, 0, 2, "PREDOMINANTLY_CONTRADICTED"), (1, 0, 0, "SINGLE_SOURCE_CLAIM"), (1, 1, 0, "SINGLE_SOURCE_CLAIM"), (0, 0, 0, "UNADDRESSED"),
])
def test_verdicts(spark, sup, ind, con, expected):
    assert one(spark, consensus.verdict(F.lit(sup), F.lit(ind), F.lit(con))) == expected


def test_consensus_of_a_small_run(spark):
    claim = "Drift monitors lower the error rate"
    evidence = spark.createDataFrame([
        Row(run_id="r", item_id=1, evidence_id="e1", source_key="k1", claim=claim, evidence="said so"), Row(run_id="r", item_id=2, evidence_id="e2", source_key="k1", claim="Drift monitors lower the error rates", evidence="again"),
        Row(run_id="r", item_id=3, evidence_id="e3", source_key="k1", claim="Buy a discount lamp", evidence="ad"),
    ])
    v = spark.createDataFrame([(i, f"e{i}", "k1", c, "ENTAILMENT", 0.9) for i, c in ((1, claim), (2, "x"), (3, "y"))], "verdict_id int, evidence_id string, source_key string, claim string, label string, confidence double")
    core = consensus.core_claims(evidence, v)
    assert [r.item_id for r in core.collect()] == [1]
    sources = spark.createDataFrame([
        ("r", 1, 1, "10.1/own", "", "Own", "Drift monitors lower the error rate.", False), ("r", 2, 2, "10.1/b", "", "B", "Here drift monitors lower the error rate.", False),
        ("r", 3, 3, "https://doi.org/10.1/b", "", "B again", "Drift monitors never lower the error rate.", False), ("r", 4, 4, "", "http://c", "C", "Drift monitors never lower the error rate.", True), ("r", 5, 5, "", "http://d", "D", "", False),
    ], "run_id string, source_id int, pos int, doi string, url string, title string, content string, is_retracted boolean")
    claims = core.select("run_id", F.col("item_id").alias("claim_id"), "claim", "evidence", F.lit("doi:10.1/own").alias("cid"), F.lit("").alias("skey"), F.lit(False).alias("is_retracted"))
    p = consensus.profiles(claims, consensus.assess(claims, sources)).first()
    assert (p.supporting, p.independent, p.contradicting, p.alerts, p.verdict) == (2, 1, 0, 1, "CONSISTENT_SUPPORT")


def test_citation_audit(spark):
    body = "\n".join([
        "# Heading that is long enough to look like one [1]", "Drift monitors lower the error rate in fleets [1]. The cause of this remains quite unclear today.", "Short one [7].", "| a table row with many words in it |",
        "```", "code that is long enough to be a sentence here.", "```", "### Claim Verification Results", "A sentence inside the block that would be eligible.", "## Next", "- ❌ a bullet of the audit with many words inside",
    ])
    df = spark.createDataFrame([(1, body), (2, ""), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in citations.audit(df, F.lit(2)).collect()}
    assert (got[1].total_markers, got[1].invalid_markers, got[1].eligible, got[1].cited, got[1].coverage_percent) == (3, 1, 2, 1, 50.0)
    assert got[2].eligible == 0 and got[3].coverage_percent is None


def test_inline_markers_of_the_body_only(spark):
    assert one(spark, citations.inline_count(F.lit("a [1] b [2, 3] c [4]\n## Sources\n[5]"))) == 2


def test_invented_dois(spark):
    t = spark.createDataFrame([("r", "see 10.1234/a. and 10.1234/B, not 10.9999/zz")], "k string, t string")
    s = spark.createDataFrame([("r", "https://doi.org/10.1234/A"), ("r", "10.1234/b"), ("q", "10.9999/zz")], "k string, doi string")
    assert [r.doi for r in citations.invented_dois(t, s, "k", "t").collect()] == ["10.9999/zz"]
    assert one(spark, citations.without_lines_of(F.lit("keep\ndrop 10.9999/zz\nkeep too"), F.array(F.lit("10.9999/zz")))) == "keep\nkeep too"


def test_numbering_lets_a_bridge_repoint_its_names():
    assert citations.number_sources(["a", "b", "c", "", "b"], [["doi:1"], ["url:b"], ["doi:1", "url:b"], [], ["url:b"]]) == [1, 2, 1, None, 1]


def test_citation_numbers(spark):
    df = spark.createDataFrame([("r", 1, "10.1/a", "http://x"), ("r", 2, "", "http://x/"), ("r", 3, "", ""), ("r", 4, "", "http://y")], "run_id string, pos int, doi string, url string")
    assert sorted((r.pos, r.number) for r in citations.citation_numbers(df, "run_id", "pos").collect()) == [(1, 1), (2, 1), (4, 2)]


# Published inputs and overall scores of five reports.
PUBLISHED = [(1.0, 0.40, 8.63, True, 6.8, 7.64), (3 / 14, 0.40, 5.22, True, 7.0, 6.77), (0.0, 0.40, 7.58, True, 6.0, 6.09), (0.0, 0.37, 4.78, True, 6.6, 6.27), (0.0, 0.40, 6.96, True, 7.0, 6.66)]


@pytest.mark.parametrize("cov, div, dens, gap, judge, score", PUBLISHED)
def test_overall_scores(spark, cov, div, dens, gap, judge, score):
    got = one(spark, scorecard.overall(F.lit(1.0), F.lit(cov), F.lit(div), F.lit(dens), F.lit(gap), F.lit(judge)))
    assert got == pytest.approx(score, abs=0.011)


def test_report_measures(spark):
    assert one(spark, scorecard.density(F.lit(3), F.lit("one two three four"))) == 750.0 and one(spark, scorecard.density(F.lit(3), F.lit(" "))) == 0.0
    assert one(spark, scorecard.diversity(F.lit(12), F.lit(8))) == 0.4 and one(spark, scorecard.diversity(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, scorecard.gap_acknowledged(F.lit("Knowledge Gaps " + "word " * 50))) and not one(spark, scorecard.gap_acknowledged(F.lit("Knowledge gaps: none")))


def test_authors_overlap(spark):
    f = lambda a, b: one(spark, registry.authors_overlap(F.lit(a).cast("array<string>"), F.lit(b).cast("array<string>")))
    assert f(["Ann Lee", "Bo Ray"], ["Lee, A.", "Cy Fox"]) is True and f(["Ann Lee"], ["Bo Ray"]) is False and f([], ["Bo Ray"]) is None and f(["Ann Lee", "Bo Ray"], ["Bo Ray", "Ann Lee"]) is False


@pytest.mark.parametrize("oa, cr, so, sc, sb, am, jm, ret, conf, agree, ident", [
    ("VERIFIED", "VERIFIED", 0.9, 0.8, 0.9, True, True, False, "HIGH", "HIGH", "VERIFIED"), ("VERIFIED", "VERIFIED", 0.75, 0.7, 0.65, None, None, False, "MEDIUM", "MODERATE", "PROVISIONAL"),
    ("VERIFIED", "VERIFIED", 0.3, 0.2, 0.9, None, None, False, "LOW", "MISMATCH", "IDENTITY_MISMATCH"), ("VERIFIED", "TIMEOUT", 0.8, 0.0, 0.0, None, None, False, "MEDIUM", "SINGLE_SOURCE (Crossref unavailable)", "PROVISIONAL"),
    ("NOT_FOUND", "VERIFIED", 0.0, 0.8, 0.0, None, None, True, "MEDIUM", "SINGLE_SOURCE (Registry discrepancy)", "RETRACTED"), ("NOT_FOUND", "NOT_FOUND", 0.0, 0.0, 0.0, None, None, False, "LOW", "NOT_FOUND", "UNVERIFIED"),
    ("TIMEOUT", "RATE_LIMITED", 0.0, 0.0, 0.0, None, None, False, "LOW", "UNAVAILABLE", "UNVERIFIED"), ("VERIFIED", "VERIFIED", 0.9, 0.9, 0.9, True, False, False, "MEDIUM", "MODERATE", "PROVISIONAL"),
])
def test_registry_decisions(spark, oa, cr, so, sc, sb, am, jm, ret, conf, agree, ident):
    df = spark.createDataFrame([(oa, cr, so, sc, sb, am, jm, ret)], "oa_status string, cr_status string, sim_oa double, sim_cr double, sim_both double, authors_match boolean, journal_match boolean, is_retracted boolean")
    r = registry.decide(df).first()
    assert (r.confidence, r.agreement, r.identity_status) == (conf, agree, ident)


def test_title_similarity(spark):
    f = lambda a, b: one(spark, registry.token_similarity(F.lit(a), F.lit(b)))
    assert f("A <i>drift</i> &amp; bias", "a drift bias") == 1.0 and f("", "x") == 0.0 and 0.8 < f("drift monitoring", "drift monitorin") < 1.0


def test_quotations():
    src = "We measured the drift in forty fleets over two years. The monitor lowered the error rate by half in all of them. Costs fell."
    assert quotes.recover("the monitor lowered the error rate by half in all of them", src) == "The monitor lowered the error rate by half in all of them."
    assert quotes.recover("The monitor “lowered” the error rate by a half in all of them.", src).startswith("The monitor lowered")
    assert quotes.recover("Aliens landed on the roof of the university building yesterday.", src) is None and quotes.recover("too short", src) is None and quotes.recover(None, src) is None
    assert quotes.in_source("forty fleets over two years", "T", src) and not quotes.in_source("something else entirely here", "T", src) and not quotes.in_source("", "T", src)


def test_cache(spark):
    df = spark.createDataFrame([(1, "2025-01-01 00:00:00"), (2, "2025-01-08 00:00:01"), (3, None)], "k int, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = {r.k: r.hit for r in fresh(df, "t", F.lit("2025-01-08 00:00:01").cast("timestamp"), 168).collect()}
    assert got == {1: False, 2: True, 3: False}
    assert [r.k for r in missing(df, df.where("k < 3"), "k").collect()] == [3]


def test_repartitioning_changes_nothing(spark):
    df = spark.createDataFrame([("r", i, f"10.1/{i % 7}") for i in range(50)], "run_id string, pos int, doi string")
    a, b = (sorted(r.pos for r in ordered.first_wins_if_given(x, literature_doi(F.col("doi")), ["run_id"], ["pos"]).collect()) for x in (df, df.repartition(7)))
    assert a == b == list(range(7))
    assert tx.jaccard is not None
