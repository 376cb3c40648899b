import pytest
from pyspark.sql import functions as F

from attesta.plans import render, rounds
from attesta.sources import providers
from attesta.streaming import arrivals


def test_scores_come_back_for_every_pair(spark):
    def fragile():
        def model(pairs):
            if any("bad" in p for _, p in pairs):
                raise RuntimeError("no")
            return providers.rule_scorer(pairs)
        return model
    df = spark.createDataFrame([(1, "drift lowers error", "drift lowers error"), (2, "drift", "bad"), (3, "", "x"), (4, None, None), (5, "drift lowers error", "drift never lowers error")], "k int, c string, p string")
    got = {r.k: r for r in providers.score_pairs(df, "k", "c", "p", fragile).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "ok", 2: "failed", 3: "blank", 4: "blank", 5: "ok"}
    assert got[1].scores[0].label == "ENTAILMENT" and got[5].scores[0].label == "CONTRADICTION"


def test_offline_defaults():
    a, b, c = providers.hash_embedder(["drift monitor", "monitor drift", ""])
    assert a == b and sum(x * x for x in a) == pytest.approx(1) and not any(c)
    def fails(q, n):
        raise OSError
    assert providers.first_that_answers([fails, lambda q, n: [], lambda q, n: [{"u": 1}, {"u": 2}]], "q", 1, 2) == [{"u": 1}] and providers.first_that_answers([fails], "q", 1) == []
    assert providers.no_text("p", "d") == "d"


def test_rounds_stop_without_news(spark):
    pages = {1: [("r", 1, "http://a"), ("r", 2, "HTTP://A ")], 2: [("r", 1, "http://b")]}
    make = lambda n: spark.createDataFrame(pages[n], "run_id string, pos int, url string")
    out, n = rounds.research(make, lambda df: True)
    assert n == 2 and sorted(r.url for r in out.collect()) == ["http://a", "http://b"]
    assert rounds.research(make, lambda df: False)[1] == 1
    out, n = rounds.research(lambda n: make(1), lambda df: True)
    assert n == 2 and out.count() == 1


def test_rows_of_tables(spark):
    df = spark.createDataFrame([("T" * 50, "VERIFIED", "ODD", True, "", "unknown", None, 0.8, "a|b", None, "HIGH")], "title string, openalex_status string, crossref_status string, is_retracted boolean, issn string, journal_name string, publisher string, title_similarity double, metadata_agreement string, identity_status string, confidence_level string")
    row = df.select(render.quality_row(F.lit(3)).alias("r")).first().r
    assert row.startswith("| [3] | " + "T" * 42 + "... | ✅ Verified | ⚠️ Unavailable | 🔴 **RETRACTED** | Academic Record | `N/A` | ✅ Match (0.80) | a/b | ⚪ UNVERIFIED | 🟢 HIGH |")
    j = spark.createDataFrame([("r", 2, "b"), ("r", 1, "a")], "run_id string, n int, row string")
    assert render.joined(j, "run_id", "n", "row", "head").first().text == "head\na\nb"


def test_streams(spark, tmp_path):
    rows = [("10.1/a", "", "2024-01-01 00:00:00", "x"), ("doi:10.1/A", "", "2024-01-01 00:05:00", "x"), ("", "http://b", "2024-01-01 02:00:00", "y"), ("", "", "2024-01-01 03:00:00", "y")]
    df = spark.createDataFrame(rows, "doi string, url string, t string, kind string").withColumn("t", F.col("t").cast("timestamp")).withColumn("title", F.lit(None).cast("string"))
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    def run(out, name):
        out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()
    assert len(run(arrivals.first_arrivals(stream(), "t"), "firsts")) == 2
    assert {(r.kind, r.n) for r in run(arrivals.counts_by_window(stream(), "t", "kind"), "counts")} == {("x", 2)}
    assert ("x", 2) in {(r.kind, r.n) for r in run(arrivals.sessions(stream(), "t", "kind"), "visits")}
