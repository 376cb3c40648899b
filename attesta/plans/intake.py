"""Queries over what comes in, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators import intake as it
from attesta.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


_TOPIC = "Seagrass carbon storage in coastal waters under stress"


@query
def i_web_results(s, d):
    x = table(s, d, "academic_sources").select("rec_id", F.when(F.col("rec_id") % 2 == 0, F.col("url")).alias("href"), "url", F.lit(None).cast("string").alias("body"), "content", "title")
    return it.web_results(x).select("rec_id", "title", "url", "content", F.col("tier").cast("bigint").alias("tier"))


SQL["i_web_results"] = """
SELECT rec_id, coalesce(title, '') AS title, coalesce(url, '') AS url, coalesce(content, '') AS content,
CASE WHEN regexp_extract(trim(coalesce(url, ''), chr(9) || chr(10) || ' ' || chr(160)), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) = '' THEN 3 ELSE 2 END AS tier FROM academic_sources
"""


@query
def i_academic_results(s, d):
    x = it.academic_results(table(s, d, "academic_sources"))
    return x.select("rec_id", "title", "doi", "venue", F.size("authors").cast("bigint").alias("authors"), F.size("publication_types").cast("bigint").alias("types"))


_SP = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


SQL["i_academic_results"] = (
    f"SELECT rec_id, coalesce({_strip('title')}, '') AS title, coalesce({_strip('doi')}, '') AS doi, coalesce({_strip('venue')}, '') AS venue, len(coalesce(authors, [])) AS authors, len(coalesce(publication_types, [])) AS types FROM academic_sources"
)


@query
def i_openalex_works(s, d):
    w = table(s, d, "registry_works")
    source = F.struct(F.col("container_title").alias("display_name"), F.array(F.lit("1234-5678"), F.lit("8765-4321")).alias("issn"), F.lit("P").alias("host_organization_name"), (F.col("work_id") % 3 == 0).alias("is_in_doaj"))
    j = F.to_json(F.struct(
        "title", F.col("year").alias("publication_year"), (F.col("work_id") % 5 == 0).alias("is_retracted"), F.col("work_id").alias("cited_by_count"), F.array(F.lit("CrossRef"), F.when(F.col("work_id") % 2 == 0, "DBLP")).alias("indexed_in"),
        F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"), F.struct(source.alias("source")).alias("primary_location")))
    x = w.select("work_id", it.openalex_work(j).alias("r"))
    return x.select("work_id", "r.raw_title", "r.journal_name", "r.issn", F.coalesce("r.year", F.lit(0)).cast("bigint").alias("year"), "r.is_retracted", F.size("r.authors").cast("bigint").alias("authors"), F.array_join("r.indexed_in", "|").alias("indexes"))


SQL["i_openalex_works"] = """
SELECT work_id, coalesce(title, '') AS raw_title, coalesce(container_title, '') AS journal_name, '1234-5678' AS issn, CAST(coalesce(year, 0) AS BIGINT) AS year, work_id % 5 = 0 AS is_retracted,
len(list_filter(coalesce(authors, []), lambda a: a <> '')) AS authors,
'OpenAlex (DOI record found)|CrossRef (Indexed Work)' || CASE WHEN work_id % 3 = 0 THEN '|DOAJ (Directory of Open Access Journals)' ELSE '' END || CASE WHEN work_id % 2 = 0 THEN '|DBLP (Computer Science Bibliography)' ELSE '' END AS indexes FROM registry_works
"""


@query
def i_crossref_works(s, d):
    w = table(s, d, "registry_works")
    update = F.when(F.col("work_id") % 7 == 0, F.array(F.struct(F.lit("Retraction").alias("type"), F.lit(None).cast("string").alias("label"))))
    j = F.to_json(F.struct(
        F.array("title").alias("title"), F.array("container_title").alias("container-title"), F.array(F.lit("1234-5678")).alias("ISSN"), F.transform("authors", lambda a: F.struct(a.alias("family"))).alias("author"),
        update.alias("update-to"), F.struct(F.array(F.array("year")).alias("date-parts")).alias("issued")))
    x = w.select("work_id", it.crossref_work(j).alias("r"))
    return x.select("work_id", "r.raw_title", "r.journal_name", "r.issn", F.coalesce("r.year", F.lit(0)).cast("bigint").alias("year"), "r.is_retracted", F.array_join("r.authors", "|").alias("authors"))


SQL["i_crossref_works"] = """
SELECT work_id, coalesce(title, '') AS raw_title, coalesce(container_title, '') AS journal_name, '1234-5678' AS issn, CAST(coalesce(year, 0) AS BIGINT) AS year, work_id % 7 = 0 AS is_retracted,
array_to_string(list_filter(list_transform(coalesce(authors, []), lambda a: trim(a)), lambda a: a <> ''), '|') AS authors FROM registry_works
"""


@query
def i_best_contents(s, d):
    x = table(s, d, "academic_sources").withColumn("full_text", F.when(F.col("rec_id") % 7 == 0, "whole text")).withColumn("registry_abstract", F.when(F.col("rec_id") % 2 == 0, "abstract of the registry"))
    return it.with_best_content(x).select("rec_id", "text_origin", F.length(F.coalesce("content", F.lit(""))).cast("bigint").alias("chars"))


SQL["i_best_contents"] = f"""
WITH a AS (SELECT rec_id, content, coalesce(doi, '') <> '' AS d, coalesce(doi, '') <> '' AND length({_strip("coalesce(content, '')")}) < 200 AS short FROM academic_sources)
SELECT rec_id, CASE WHEN d AND rec_id % 7 = 0 THEN 'full_text' WHEN short AND rec_id % 2 = 0 THEN 'openalex_abstract' WHEN short THEN NULL WHEN coalesce(content, '') <> '' THEN 'search_abstract' ELSE 'none' END AS text_origin,
CASE WHEN d AND rec_id % 7 = 0 THEN 10 WHEN short AND rec_id % 2 = 0 THEN 24 ELSE length(coalesce(content, '')) END AS chars FROM a
"""


@query
def i_retraction_reasons(s, d):
    w = table(s, d, "registry_works")
    return w.select("work_id", it.retraction_reason(F.col("work_id") % 2 == 0, F.col("work_id") % 3 == 0).alias("reason"))


SQL["i_retraction_reasons"] = """
SELECT work_id, concat_ws('; ', CASE WHEN work_id % 2 = 0 THEN 'OpenAlex / Retraction Watch flagged paper as RETRACTED' END, CASE WHEN work_id % 3 = 0 THEN 'Crossref record flags publication as RETRACTED' END) AS reason FROM registry_works
"""


@query
def i_gaps_and_queries(s, d):
    words = F.split(tx.one_line(F.coalesce("claim", F.lit(""))), " ")
    answer = F.concat(F.lit("Intro\nGAP: early\nGAP: "), F.coalesce("claim", F.lit("")), F.lit("\nQUERY: "), F.array_join(F.slice(words, F.lit(1), (F.col("item_id") % 4 + 1).cast("int")), " "))
    x = table(s, d, "evidence_items").select("item_id", it.gap_and_query(answer, F.lit(_TOPIC)).alias("r"))
    return x.select("item_id", "r.gap", "r.query", it.follow_up(F.col("r.query"), F.lit(_TOPIC)).alias("follow_up"))


SQL["i_gaps_and_queries"] = f"""
WITH a AS (SELECT item_id, {_strip("coalesce(claim, '')")} AS gap, array_to_string(list_slice(string_split(trim(regexp_replace(coalesce(claim, ''), '{_SP}+', ' ', 'g')), ' '), 1, item_id % 4 + 1), ' ') AS q FROM evidence_items),
b AS (SELECT item_id, gap, CASE WHEN q <> '' AND len(string_split(q, ' ')) <= 2 THEN 'Seagrass carbon storage ' || q ELSE q END AS query FROM a)
SELECT item_id, gap, query, CASE WHEN query <> '' AND NOT contains(lower(query), 'seagrass carbon storage in') THEN 'Seagrass carbon storage in ' || query ELSE query END AS follow_up FROM b
"""


@query
def i_first_sentences(s, d):
    return table(s, d, "academic_sources").where("content IS NOT NULL").select("rec_id", it.first_sentences(F.col("content")).alias("head"))


_HEAD = "array_to_string(list_slice(string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1, 2), ' ')"
SQL["i_first_sentences"] = f"""
WITH a AS (SELECT rec_id, trim(regexp_replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '{_SP}+', ' ', 'g')) AS p FROM academic_sources WHERE content IS NOT NULL),
b AS (SELECT rec_id, trim(translate({_HEAD}, '|' || chr(10), '/ ')) AS t FROM a)
SELECT rec_id, CASE WHEN length(t) > 300 THEN regexp_replace(substr(t, 1, 300), ' [^ ]*$', '') || '…' ELSE t END AS head FROM b
"""


@query
def i_accepted(s, d):
    """Items of pinned sources, of which one has a tenth of all, go with the few pinned ones broadcast."""
    cols = [F.concat(F.lit("source_"), F.col("rec_id").cast("string")).alias("source_id"), "content"]
    pinned = F.broadcast(table(s, d, "pinned_sources").select(*cols))
    items = table(s, d, "evidence_items").select("item_id", "source_id", "evidence", "claim")
    rest = items.join(F.broadcast(pinned.select("source_id")), "source_id", "left_anti")
    return it.accepted_extractions(rest, table(s, d, "academic_sources").select(*cols)).unionByName(it.accepted_extractions(items, pinned))


@query
def i_unconfirmed(s, d):
    return it.unconfirmed(table(s, d, "verdicts")).select("verdict_id", "label", "icon")


SQL["i_unconfirmed"] = f"""
SELECT verdict_id, l AS label, CASE l WHEN 'CONTRADICTION' THEN '❌' WHEN 'NEUTRAL' THEN '⚠️' ELSE 'ℹ️' END AS icon
FROM (SELECT *, upper(coalesce(nullif({_strip('label')}, ''), 'UNVERIFIED')) AS l FROM verdicts) WHERE l <> 'ENTAILMENT' AND length({_strip("coalesce(claim, '')")}) >= 5
"""


@query
def i_source_profiles(s, d):
    """Evidence with the profile of its source: by address, else by DOI."""
    from attesta.functions.identity import report_doi
    from attesta.operators.lookup import fallback_lookup

    p = table(s, d, "profiles")
    by_url = p.where("url <> ''").groupBy(F.lower("url").alias("k")).agg(F.min("profile_id").alias("profile_id"))
    by_doi = p.withColumn("k", report_doi(F.col("doi"))).where("k <> ''").groupBy("k").agg(F.min("profile_id").alias("profile_id"))
    e = table(s, d, "evidence_items").select("item_id", "source_url", "doi")
    keys = [(F.when(F.col("source_url") != "", F.lower("source_url")), by_url), (F.nullif(report_doi(F.col("doi")), F.lit("")), by_doi)]
    return fallback_lookup(e, keys, "profile_id").select("item_id", F.coalesce("profile_id", F.lit(0)).alias("profile_id"))


_RD = lambda x: f"regexp_replace(regexp_replace(lower({_strip(f'coalesce({x}, {chr(39) * 2})')}), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', ''), '/+$', '')"
SQL["i_source_profiles"] = f"""
WITH u AS (SELECT lower(url) AS k, min(profile_id) AS p FROM profiles WHERE url <> '' GROUP BY 1), v AS (SELECT {_RD('doi')} AS k, min(profile_id) AS p FROM profiles WHERE {_RD('doi')} <> '' GROUP BY 1)
SELECT e.item_id, coalesce(u.p, v.p, 0) AS profile_id FROM evidence_items e LEFT JOIN u ON u.k = lower(e.source_url) AND e.source_url <> '' LEFT JOIN v ON v.k = {_RD('e.doi')}
"""
