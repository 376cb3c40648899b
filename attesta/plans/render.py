"""Reports and tables as Markdown: one expression a row, joined in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import authors_line, cell, cut_cell, strip


def _badge(c: Column, names: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in reversed(names.items()):
        out = F.when(c == k, v).otherwise(out)
    return out


# How states are shown.
REGISTRY = {"VERIFIED": "✅ Verified", "NOT_FOUND": "❌ Not Found", "TIMEOUT": "⏳ Timeout", "SKIPPED": "⚪ Preprint"}
IDENTITY = {"VERIFIED": "🟢 VERIFIED", "PROVISIONAL": "🟡 PROVISIONAL", "IDENTITY_MISMATCH": "🔴 MISMATCH", "RETRACTED": "🔴 RETRACTED"}
CONFIDENCE = {"HIGH": "🟢 HIGH", "MEDIUM": "🟡 MEDIUM", "RETRACTED_WARNING": "🔴 RETRACTED"}
QUALITY_HEAD = (
    "| # | Paper Title | OpenAlex | Crossref | Retraction Status | Journal / Venue | ISSN | Title Match | Metadata Agreement | Identity Status | Identity Confidence |\n"
    "|---|-------------|----------|----------|-------------------|-----------------|------|-------------|--------------------|-----------------|---------------------|"
)


def _short(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def _given(c: str) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))


def quality_row(number: Column) -> Column:
    """A row of the quality table from the columns of a profile."""
    title = _short(F.coalesce(_given("title"), F.lit("Untitled")), 42)
    venue = F.trim(F.coalesce(_given("journal_name"), _given("publisher"), F.lit("Academic Record")))
    venue = F.when(F.lower(venue).isin("unknown", "", "none"), F.coalesce(_given("publisher"), F.lit("Academic Record"))).otherwise(venue)
    sim = F.format_string("%.2f", F.round(F.coalesce("title_similarity", F.lit(0.0)), 2))
    match = F.when(F.coalesce("title_similarity", F.lit(0.0)) >= 0.75, F.concat(F.lit("✅ Match ("), sim, F.lit(")"))).otherwise(F.concat(F.lit("⚠️ Review ("), sim, F.lit(")")))
    parts = [
        F.concat(F.lit("["), number.cast("string"), F.lit("]")), title, _badge(F.col("openalex_status"), REGISTRY, "⚠️ Unavailable"), _badge(F.col("crossref_status"), REGISTRY, "⚠️ Unavailable"),
        F.when(F.coalesce("is_retracted", F.lit(False)), "🔴 **RETRACTED**").otherwise("🟢 No retraction flag (OpenAlex/Crossref)"), _short(venue, 45),
        F.concat(F.lit("`"), F.coalesce(_given("issn"), F.lit("N/A")), F.lit("`")), match, F.translate(F.coalesce("metadata_agreement", F.lit("N/A")), "|\n", "/ "),
        _badge(F.col("identity_status"), IDENTITY, "⚪ UNVERIFIED"), _badge(F.col("confidence_level"), CONFIDENCE, "⚪ LOW"),
    ]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))


def literature_row(number: Column, claims: Column) -> Column:
    """A row of the literature table: title, authors, venue and up to three verified claims."""
    venue = F.coalesce(F.when(~F.lower(F.trim(F.coalesce("venue", F.lit("")))).isin("", "unknown", "none"), F.trim(F.col("venue"))), F.lit("N/A"))
    shown = F.transform(F.slice(claims, 1, 3), lambda c: F.concat(F.lit("• "), cut_cell(c, 220), F.lit(" *(verified)*")))
    text = F.when(F.size(claims) > 0, F.array_join(shown, "<br>")).otherwise("No verified claims extracted")
    parts = [number.cast("string"), cell(F.coalesce(F.col("title"), F.lit("Untitled")), 100_000), authors_line(F.col("authors")), cell(venue, 100_000), text]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))


def source_entry(number: Column) -> Column:
    """An entry of the source list."""
    details = F.concat_ws(
        " | ",
        F.concat(F.lit("**Harvested From:** "), F.coalesce(_given("source"), F.lit("Web Search"))), F.concat(F.lit("**Venue:** *"), _given("venue"), F.lit("*")),
    )
    return F.concat(F.lit("["), number.cast("string"), F.lit("] ["), F.coalesce("title", F.lit("Untitled")), F.lit("]("), F.coalesce("url", F.lit("")), F.lit(")\n    "), details)


def audit_text(eligible: Column, cited: Column, coverage: Column, invalid: Column, total: Column) -> Column:
    """The citation audit of a report."""
    return F.concat(
        F.lit("## Citation Integrity Audit\n\n- Eligible factual-claim candidates: "), eligible.cast("string"), F.lit("\n- Candidates with at least one registered citation: "), cited.cast("string"),
        F.lit("\n- Claim-level citation coverage: "), F.when(coverage.isNull(), "None").otherwise(F.format_string("%.2f", coverage)), F.lit("%\n- Invalid citation marker occurrences: "), invalid.cast("string"),
        F.lit("\n- Total inline citation marker occurrences: "), total.cast("string"),
    )


def eval_summary(overall: Column, sections: Column, coverage: Column, density: Column, gap: Column) -> Column:
    """One line on a report's scores."""
    return F.concat(
        F.format_string("Score %.2f/10 | sections %d%% | citation coverage %d%% | evidence %.2f per 1k words", overall, F.round(sections * 100).cast("int"), F.round(coverage * 100).cast("int"), density),
        F.lit(" | gap noted "), F.when(gap, "YES").otherwise("NO"),
    )


# Fixed value: the heading before which claims without support are put.
RECOMMENDATIONS = "## 6. Recommendations"


def spliced(report: Column, block: Column) -> Column:
    """A report with a block before its recommendations, or at its end; what follows a second such heading is dropped."""
    parts = F.split(report, RECOMMENDATIONS.replace(".", r"\."))
    return F.when(F.size(parts) > 1, F.concat(F.get(parts, F.lit(0)), block, F.lit("\n\n" + RECOMMENDATIONS), F.get(parts, F.lit(1)))).otherwise(F.concat(report, block))


def gap_section(report: Column) -> Column:
    """What a report says under its fifth heading, the knowledge gaps; '' if it has none."""
    return strip(F.regexp_extract(report, r"(?s)##\s*5\.\s*Knowledge Gaps\s*(.*?)(?=\n##\s*6\.|\z)", 1))


def whole_report(body: Column, literature: Column, consensus: Column, quality: Column, audit: Column, sources: Column) -> Column:
    """A finished report from its parts, in order; a part that is NULL is empty."""
    parts = [F.coalesce(c, F.lit("")) for c in (body, literature, consensus, quality, audit)]
    return F.concat(*parts, F.lit("\n\n### Sources\n\n"), F.coalesce(sources, F.lit("")))


# How novelty and difficulty are shown.
NOVELTY = {"HIGH": "🔴", "MEDIUM": "🟡", "LOW": "🟢"}
DIFFICULTY = {"STARTER": "⭐", "INTERMEDIATE": "⭐⭐", "ADVANCED": "⭐⭐⭐"}


def recommendations(topic: Column, summary: Column, items: Column) -> Column:
    """The section on research opportunities from an ordered array of ``struct<title,novelty,difficulty,gap,approach>``."""
    entry = lambda r, i: F.concat(
        F.lit("### "), (i + 1).cast("string"), F.lit(". "), r["title"], F.lit("\n\n**Novelty:** "), _badge(r["novelty"], NOVELTY, ""), F.lit(" "), r["novelty"], F.lit(" &nbsp;|&nbsp; **Difficulty:** "),
        _badge(r["difficulty"], DIFFICULTY, ""), F.lit(" "), r["difficulty"], F.lit("\n\n**Why under-explored:** "), r["gap"], F.lit("\n\n**Suggested approach:** "), r["approach"], F.lit("\n"))
    head = F.concat(F.lit("\n\n---\n\n## Research Opportunities\n\n> *Under-explored directions in: **"), topic, F.lit("***\n\n"), summary, F.lit("\n\n"))
    none = F.lit("\n\n---\n\n## Research Opportunities\n\n*No recommendations could be generated.*\n")
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.concat(head, F.array_join(F.transform(items, entry), "\n"))).otherwise(none)


def joined(rows: DataFrame, scope: str, order: str, row: str, head: str = "") -> DataFrame:
    """``(scope, text)``: the rows of each scope in order below ``head``. Made for what a report shows, some dozens of rows."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, row))), lambda x: x[row]), "\n")
    return rows.groupBy(scope).agg(F.concat(F.lit(head + "\n" if head else ""), lines).alias("text"))
