import json

from pyspark.sql import functions as F

from attesta.operators import intake as it


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_registry_records(spark):
    oa = {"title": "A <i>B</i>", "publication_year": 2020, "is_retracted": True, "indexed_in": ["PubMed"], "authorships": [{"author": {"display_name": "Ann"}}, {"author": {}}, {}], "primary_location": {"source": {"issn": ["1-2"], "is_in_doaj": True}}}
    r = one(spark, it.openalex_work(F.lit(json.dumps(oa))))
    assert (r.title, r.issn, r.authors, r.year, r.is_retracted) == ("a b", "1-2", ["Ann"], 2020, True) and list(r.indexed_in) == ["OpenAlex (DOI record found)", "PubMed / MEDLINE", "DOAJ (Directory of Open Access Journals)"]
    empty = one(spark, it.openalex_work(F.lit("{}")))
    assert (empty.raw_title, empty.authors, empty.is_retracted) == ("", [], False)
    cr = {"title": ["T"], "author": [{"given": "A", "family": "B"}, {"name": "Team"}, {}], "assertion": [{"label": "Retracted article"}], "issued": {"date-parts": [[2019, 1]]}}
    r = one(spark, it.crossref_work(F.lit(json.dumps(cr))))
    assert (r.raw_title, r.authors, r.year, r.is_retracted) == ("T", ["A B", "Team"], 2019, True)
    assert one(spark, it.crossref_work(F.lit('{"updated-by":[{"type":"Withdrawal"}]}'))).is_retracted and not one(spark, it.crossref_work(F.lit('{"type":"journal-article"}'))).is_retracted


def test_contents_fall_back(spark):
    rows = [(1, "10.1/a", "short", "full", "abs"), (2, "10.1/a", "short", None, "abs"), (3, "10.1/a", "short", None, None), (4, "", "short", "full", "abs"), (5, None, "", None, None), (6, "10.1/a", "x" * 300, None, "abs")]
    df = spark.createDataFrame(rows, "k int, doi string, content string, full_text string, registry_abstract string")
    got = {r.k: (r.text_origin, r.content[:5]) for r in it.with_best_content(df).collect()}
    assert got == {1: ("full_text", "full"), 2: ("openalex_abstract", "abs"), 3: (None, "short"), 4: ("search_abstract", "short"), 5: ("none", ""), 6: ("search_abstract", "xxxxx")}


def test_answers(spark):
    r = one(spark, it.gap_and_query(F.lit("GAP: a\nQUERY: one\nGAP: b c \nQUERY: Chain"), F.lit("The drift of deep sensor models")))
    assert (r.gap, r.query) == ("b c", "drift deep sensor Chain")
    r = one(spark, it.gap_and_query(F.lit("nothing"), F.lit("topic words")))
    assert (r.gap, r.query) == ("", "")
    f = lambda q: one(spark, it.follow_up(F.lit(q), F.lit("a b c d e")))
    assert f("x") == "a b c d x" and f("see A B C D") == "see A B C D" and f("") == ""


def test_extractions_are_accepted_or_recovered(spark):
    src = spark.createDataFrame([("s1", "The monitor lowered the error rate by half in all of the fleets. Costs fell.")], "source_id string, content string")
    items = spark.createDataFrame([
        (1, "s1", "lowered the error  rate by half", "The monitor lowers the error rate"), (2, "s1", "the monitor lowered the error rate by half in all the fleets", "The monitor lowers the error rate"),
        (3, "s1", "Aliens landed on the roof of the building yesterday", "The monitor lowers the error rate"), (4, "s9", "lowered", "The monitor lowers the error rate"), (5, "s1", "Costs fell.", "Too short"), (6, "s1", None, None),
    ], "item_id int, source_id string, evidence string, claim string")
    got = {r.item_id: r.evidence for r in it.accepted_extractions(items, src).collect()}
    assert got == {1: "lowered the error  rate by half", 2: "The monitor lowered the error rate by half in all of the fleets."}
