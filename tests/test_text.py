import pytest
from pyspark.sql import functions as F

from attesta.functions import identity as idy
from attesta.functions import text as tx


def value(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("body, expected", [
    ("", []), ("Only one.", ["Only one."]), ("One. Two.", ["One. Two."]), ("One. Two. Three.", ["One. Two.", "Two. Three."]),
    ("A b. C d! E f? G h.", ["A b. C d!", "C d! E f?", "E f? G h."]), ("See Fig. 3 for it. Done. Over.", ["See Fig. 3 for it. Done.", "Done. Over."]),
    ("Used widely, e.g. here. It rose by 3.5 points. End.", ["Used widely, e.g. here. It rose by 3.5 points.", "It rose by 3.5 points. End."]),
])
def test_windows(spark, body, expected):
    assert value(spark, tx.windows(F.col("x")), x=body) == expected


def test_windows_need_a_size():
    with pytest.raises(ValueError):
        tx.windows(F.lit("x"), 0)


def test_keywords_drop_stop_words_and_other_scripts(spark):
    assert sorted(value(spark, tx.keywords(F.col("x")), x="The model shows an error of модель in the Drift, drift 3D")) == ["drift", "error", "model"]


@pytest.mark.parametrize("q, expected", [
    ("QUERY: \"drift AND bias\"", "drift bias"), ("Search: a (b) [c]?", "a b c"),
    ("how the various effects of a very long question about drift models behave in deployed systems", "effects very long question drift models behave"), ("", ""),
])
def test_clean_query(spark, q, expected):
    assert value(spark, tx.clean_query(F.col("x")), x=q) == expected


def test_cells_and_author_lines(spark):
    assert value(spark, tx.cell(F.col("x"), 12), x="a|b c\nd efgh ijkl") == "a/b c d…"
    df = spark.createDataFrame([(["A", "B", "", "C", "D"],), ([],), (None,)], "a array<string>")
    assert [r[0] for r in df.select(tx.authors_line(F.col("a"))).collect()] == ["A, B, C et al.", "N/A", "N/A"]


def test_inverted_index_keeps_the_later_word_of_a_clash(spark):
    df = spark.sql("SELECT map('a', array(0, 2), 'b', array(1), 'c', array(1)) AS m")
    assert df.select(tx.from_inverted_index(F.col("m"))).first()[0] == "a c a"


def test_key_passages_prefer_cues_and_stop_at_references(spark):
    body = "This sentence is long enough to be looked at by the picker. We find that the drift monitor lowers the error rate by half.\n# References\nWe show nothing here that would count as a finding at all."
    assert value(spark, tx.key_passages(F.col("x")), x=body) == "We find that the drift monitor lowers the error rate by half."


def test_source_keys_take_the_first_identifier(spark):
    k = lambda d, u, t: value(spark, idy.source_key(F.col("d"), F.col("u"), F.col("t")), d=d, u=u, t=t)
    assert k("10.1/A/", None, None) == k(" 10.1/a", "http://x", "t") != k("https://doi.org/10.1/a", None, None)
    assert k("", "", "") == "" and k(None, "http://x/", None) == k("", "HTTP://X", "t")


def test_canonical_ids(spark):
    c = lambda d, u, t: value(spark, idy.canonical_id(F.col("d"), F.col("u"), F.col("t")), d=d, u=u, t=t)
    assert c("https://doi.org/10.1/X/", None, None) == "doi:10.1/x"
    assert c("", "https://doi.org/10.1234/ab(c)", None) == "doi:10.1234/ab(c)"
    assert c(None, "HTTP://A.b/C/", "t") == "url:http://a.b/c" and c(None, "", "A  title: one") == "title:a title one" and c(None, None, " ") is None


def test_urls(spark):
    u = "HTTPS://u:p@Host.org:80/a/?utm_source=x&b=1&c=&ref=q#top"
    assert value(spark, idy.web_url(F.col("x")), x=u) == "https://host.org/a?b=1"
    assert value(spark, idy.research_url(F.col("x")), x=u) == "https://u:p@host.org:80/a?b=1&ref=q"
    assert value(spark, idy.report_url(F.col("x")), x=u) == "https://u:p@host.org:80/a"
    assert value(spark, idy.report_url(F.col("x")), x="doi:10.1/A/") == "https://doi.org/10.1/a"
    assert value(spark, idy.aliases(F.col("d"), F.col("x")), d="", x="https://doi.org/10.1/A") == ["doi:10.1/a", "url:https://doi.org/10.1/A"]
