"""Steps with providers, sinks and the passages found by meaning."""

import json
import math

from attesta.operators import retrieval
from attesta.plans import nodes
from attesta.sources import sinks
from pyspark.sql import functions as F


def _fails(prompt, default):
    raise RuntimeError("no model")


def test_every_step_works_without_a_provider(spark):
    runs = spark.createDataFrame([("r", "Seagrass carbon storage in coastal waters")], "run_id string, topic string")
    src = spark.createDataFrame([("r", 0, "s1", "A title", "https://a.example/x", "Seagrass stores carbon. It is measured.", "10.1/x")], "run_id string, pos int, source_id string, title string, url string, content string, doi string")
    assert nodes.research(runs).count() == 0 and nodes.gap_sources(runs).count() == 0 and nodes.extracted(src).count() == 0 and nodes.recommended(runs, src).count() == 0
    assert nodes.initial_query(runs).first()["query"] == "Seagrass carbon storage in coastal waters"
    s = nodes.summaries(runs, src)
    assert s.first()["summary"] == ""
    assert nodes.criticised(s, lambda: _fails).first()["decision"] == "SUFFICIENT"
    assert "## 6. Recommendations" in nodes.report_bodies(nodes.gaps(s)).first()["body"]
    assert nodes.judged(spark.createDataFrame([("r", "t")], "run_id string, text string")).first()["average"] is None
    assert nodes.registry_records(src).first()["status"] == "UNAVAILABLE" and nodes.full_texts(src).first()["full_text"] == ""


def test_answers_are_read_and_checked(spark):
    runs = spark.createDataFrame([("r", "Seagrass carbon", "so far")], "run_id string, topic string, summary string")
    c = nodes.criticised(runs, lambda: lambda p, d: json.dumps({"decision": "more_research", "query": "sediment cores"})).first()
    assert c["decision"] == "MORE_RESEARCH" and c["follow_up"] == "Seagrass carbon sediment cores"
    g = nodes.gaps(runs, lambda: lambda p, d: "GAP: depth\nQUERY: cores").first()
    assert g["gap"] == "depth" and g["query"] == "Seagrass carbon cores"
    scores = {n: 8 for n in nodes.JUDGED}
    assert nodes.judged(spark.createDataFrame([("r", "t")], "run_id string, text string"), lambda: lambda p, d: json.dumps(scores)).first()["average"] == 8.0
    src = spark.createDataFrame([("r", 0, "s1", "A title", "u", "Seagrass stores carbon in deep sediment for many years.", "10.1234/x")], "run_id string, pos int, source_id string, title string, url string, content string, doi string")
    found = nodes.extracted(src, lambda: lambda rows: [{"source_id": "s1", "evidence": "stores carbon in deep sediment", "claim": "Seagrass stores carbon in the deep sediment"}, {"source_id": "s1", "evidence": "made up", "claim": "Seagrass stores carbon in the deep sediment"}])
    assert [r["evidence"] for r in found.collect()] == ["stores carbon in deep sediment"]
    a = nodes.analyses(runs, src, lambda: lambda p, d: "Good.\nSee 10.9999/none for more.").first()
    assert a["analysis"] == "Good."
    hits = nodes.research(runs.select("run_id", "topic"), lambda: lambda q, n: [{"title": "T", "url": "https://x.edu/a/", "content": "c"}, {"title": "T", "url": "https://x.edu/a", "content": "c"}, {"title": "T", "url": ""}])
    assert hits.count() == 1


def test_passages_by_meaning_follow_where_words_fail(spark):
    vectors = {"near": [1.0, 0.0], "far": [0.0, 1.0], "mid": [0.508, math.sqrt(1 - 0.508**2)]}
    embed = lambda texts: [vectors["mid"] if "paraphrase" in t else vectors["far"] if "unrelated" in t else vectors["near"] for t in texts]
    claims = spark.createDataFrame([("r", 1, "Drones lower the cost of surveys")], "run_id string, claim_id bigint, claim string")
    sources = spark.createDataFrame([("r", 10, None, "A paraphrase of it."), ("r", 11, None, "An unrelated text."), ("r", 12, None, "Drones lower the cost of surveys here. Other."), ("r", 13, None, None)], "run_id string, source_id bigint, title string, content string")
    pairs = claims.select("run_id", "claim_id").join(sources.select("run_id", "source_id"), "run_id")
    got = {r["source_id"]: (r["method"], r["score"]) for r in retrieval.cascade(pairs, claims, sources, ["run_id"], embed).collect()}
    assert set(got) == {10, 12} and got[10] == ("semantic", 0.508) and got[12][0] == "bm25"
    assert {r["source_id"] for r in retrieval.cascade(pairs, claims, sources, ["run_id"], None).collect()} == {12}
    assert {r["source_id"]: r["passage"] for r in retrieval.best_by_words(pairs, claims, sources).collect()}[12] == "Drones lower the cost of surveys here."


def test_sinks_and_topics(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"topic": f"T{i}", "type": "technical"} for i in range(4)]))
    assert sinks.topics(spark, str(tmp_path / "t.json")).count() == 4 and [r["topic"] for r in sinks.topics(spark, str(tmp_path / "t.json"), quick=True).collect()] == ["T0", "T1"]
    texts = spark.createDataFrame([("a", "one\ntwo"), ("b", "three"), (None, "x")], "name string, text string")
    sinks.save_texts(texts, str(tmp_path / "reports"))
    sinks.save_texts(texts.where("name = 'b'").withColumn("text", F.lit("four")), str(tmp_path / "reports"))
    got = {r["name"]: r["value"] for r in spark.read.text(str(tmp_path / "reports"), wholetext=True).collect()}
    assert got["a"].rstrip("\n") == "one\ntwo" and got["b"].rstrip("\n") == "four"
    entries = spark.createDataFrame([("k", 1, "2025-01-01"), ("k", 2, "2025-01-02"), ("old", 3, "2024-01-01")], "key string, v int, cached_at string").withColumn("cached_at", F.col("cached_at").cast("timestamp"))
    sinks.save_cache(entries, str(tmp_path / "cache"))
    now = F.lit("2025-01-02 12:00:00").cast("timestamp")
    assert [(r["key"], r["v"]) for r in sinks.read_cache(spark, str(tmp_path / "cache"), "key string, v int, cached_at timestamp", "key", now, 48).collect()] == [("k", 2)]
    sinks.clear_cache(spark, str(tmp_path / "cache"), "key string, v int, cached_at timestamp", now, 48, str(tmp_path / "clean"))
    assert spark.read.json(str(tmp_path / "clean")).count() == 2
    name = spark.range(1).select(sinks.file_name(F.lit("A b/c: d"), now, ".md")).first()[0]
    assert name == "20250102_120000_A_b_c__d.md"
