"""Auditing the inline citations of reports, and numbering their sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from attesta.functions import lexicon as lx
from attesta.functions.identity import aliases, literature_doi
from attesta.functions.text import strip

_MARKER = r"\[([0-9]+(?:\s*,\s*[0-9]+)*)\]"


def markers(c: Column) -> Column:
    """The numbers of all inline markers ``[n]`` and ``[n, m]``, in order."""
    groups = F.regexp_extract_all(c, F.lit(_MARKER), 1)
    return F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), lambda n: n.cast("bigint"))


def _valid(nums: Column, sources: Column) -> Column:
    return F.filter(nums, lambda n: (n >= 1) & (n <= sources))


def audit(reports: DataFrame, sources: Column, id_col: str = "doc_id", body: str = "text") -> DataFrame:
    """One row a report: markers, valid and invalid ones, sentences that need a citation and those that have one, and the share.

    Sentences inside code fences, the claim verification block and the literature table, headings, tables and rules
    need none. Whether a line is inside is a running state over the lines of one report.
    """
    r = reports.select(F.col(id_col), F.coalesce(F.col(body), F.lit("")).alias("b"), sources.alias("m"))
    nums = markers(F.col("b"))
    counts = r.select(id_col, F.size(nums).cast("bigint").alias("total_markers"), F.size(_valid(nums, F.col("m"))).cast("bigint").alias("valid_markers"))
    lines = r.select(id_col, "m", F.posexplode(F.split("b", r"\r\n|[\n\r]")).alias("i", "line")).withColumn("s", strip(F.col("line")))
    w = W.partitionBy(id_col).orderBy("i")
    fence = F.startswith("s", F.lit("```"))
    lines = lines.withColumn("fence", fence).withColumn("code", F.sum(fence.cast("int")).over(w) % 2 == 1)
    opens = F.contains("s", F.lit("### Claim Verification Results")) | F.contains("s", F.lit("## Literature Summary Table"))
    closes = F.startswith("s", F.lit("## ")) & ~opens
    state = F.when(F.col("code") | F.col("fence"), None).when(opens, F.lit(1)).when(closes, F.lit(0))
    lines = lines.withColumn("opens", opens).withColumn("inside", F.coalesce(F.last(state, ignorenulls=True).over(w), F.lit(0)) == 1)
    skip = (
        F.col("fence") | F.col("code") | F.col("inside") | F.col("opens") | (F.col("s") == "") | F.col("s").rlike(r"^(#|\||---|===)")
        | F.startswith("s", F.lit("- ❌")) | F.startswith("s", F.lit("- ⚠️")) | F.startswith("s", F.lit("- ℹ️"))
    )
    sent = lines.where(~skip).select(id_col, "m", F.explode(F.split("s", r"(?<=[.!?])\s+")).alias("t")).withColumn("t", strip(F.col("t")))
    sent = sent.where((F.length("t") >= 25) & (F.size(F.split("t", r"\s+")) >= 5) & ~F.col("t").rlike(r"^[#|]"))
    per = sent.groupBy(id_col).agg(F.count("*").alias("eligible"), F.count_if(F.size(_valid(markers(F.col("t")), F.col("m"))) > 0).alias("cited"))
    out = counts.join(per, id_col, "left")
    e, c = F.coalesce("eligible", F.lit(0)), F.coalesce("cited", F.lit(0))
    return out.select(
        id_col, "total_markers", "valid_markers", (F.col("total_markers") - F.col("valid_markers")).alias("invalid_markers"), e.cast("bigint").alias("eligible"), c.cast("bigint").alias("cited"),
        F.round(c / F.when(e > 0, e) * 100, 2).alias("coverage_percent"),
    )


def body_of(report: Column) -> Column:
    """A report before its consensus tables and source lists."""
    first = F.least(*[F.coalesce(F.nullif(F.instr(report, mark), F.lit(0)), F.length(report) + 1) for mark in lx.BODY_ENDS])
    return F.substr(report, F.lit(1), first - 1)


def inline_count(report: Column) -> Column:
    return F.regexp_count(body_of(report), F.lit(r"\[[0-9]+\]")).cast("bigint")


_DOI = r"(?i)(10\.[0-9]{4,9}/[^\s\"<>()\[\]]+)"


def dois_in(text: Column) -> Column:
    """The DOIs a text names, as literature is compared."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_DOI), 1), literature_doi))


def invented_dois(texts: DataFrame, sources: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, doi)``: DOIs named in a text that none of its sources has."""
    named = texts.select(key, F.explode(dois_in(F.col(text))).alias("doi"))
    return named.join(sources.where("doi <> ''").select(key, literature_doi(F.col("doi")).alias("doi")).distinct(), [key, "doi"], "left_anti")


def without_lines_of(text: Column, invented: Column) -> Column:
    """A text without the lines that name an invented DOI."""
    kept = F.filter(F.split(text, "\n"), lambda line: ~F.arrays_overlap(dois_in(line), invented))
    return F.when(F.size(invented) > 0, F.array_join(kept, "\n")).otherwise(text)


def number_sources(urls: list[str], named: list[list[str]]) -> list[int | None]:
    """The citation number of each source of one report, in order.

    A source takes the number of the first of its aliases that has one, else of its address, else a new one, and then all its
    aliases and its address stand for that number. A source without alias and address has none.
    """
    by_alias: dict[str, int] = {}
    by_url: dict[str, int] = {}
    out: list[int | None] = []
    last = 0
    for url, names in zip(urls, named):
        if not names and not url:
            out.append(None)
            continue
        n = next((by_alias[a] for a in names if a in by_alias), None) or by_url.get(url)
        if n is None:
            last += 1
            n = last
        if url:
            by_url[url] = n
        by_alias.update(dict.fromkeys(names, n))
        out.append(n)
    return out


def citation_numbers(sources: DataFrame, scope: str, order: str, most: int = 20) -> DataFrame:
    """``(scope, order, number)`` for the first ``most`` sources of each report, which is all a report lists.

    The limit makes the group that one fold sees small; it is part of the operator.
    """
    from attesta.operators.ordered import first_wins

    few = first_wins(sources, [scope], [order], most).select(scope, order, F.trim(F.coalesce("url", F.lit(""))).alias("url"), aliases(F.col("doi"), F.col("url")).alias("names"))
    rows = few.groupBy(scope).agg(F.array_sort(F.collect_list(F.struct(order, "url", "names"))).alias("rows"))

    @F.pandas_udf("array<int>")
    def fold(groups: pd.Series) -> pd.Series:
        return groups.map(lambda g: number_sources([r["url"] for r in g], [list(r["names"]) for r in g]))

    j = rows.select(scope, F.explode(F.arrays_zip(F.col(f"rows.{order}").alias(order), fold("rows").alias("number"))).alias("x"))
    return j.select(scope, f"x.{order}", "x.number").where("number IS NOT NULL")

