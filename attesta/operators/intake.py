"""From what searches, registries and models return to rows of one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import quotes
from attesta.functions.text import blank_to_null, let, one_line, strip
from attesta.operators.registry import clean_title
from attesta.operators.trust import tier

OPENALEX = (
    "struct<title:string,publication_year:int,is_retracted:boolean,cited_by_count:bigint,indexed_in:array<string>,ids:struct<pmid:string>,authorships:array<struct<author:struct<display_name:string>>>,"
    "primary_location:struct<source:struct<display_name:string,issn:array<string>,host_organization_name:string,is_in_doaj:boolean>>>"
)
CROSSREF = (
    "struct<title:array<string>,`container-title`:array<string>,ISSN:array<string>,publisher:string,type:string,author:array<struct<given:string,family:string,name:string>>,"
    "`update-to`:array<struct<type:string,label:string>>,`updated-by`:array<struct<type:string,label:string>>,assertion:array<struct<name:string,label:string>>,issued:struct<`date-parts`:array<array<int>>>>"
)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def web_results(raw: DataFrame) -> DataFrame:
    """``(title, url, content, tier)`` of web results that name their fields ``href``/``url`` and ``body``/``content``."""
    url, content = _text(F.coalesce("href", "url")), _text(F.coalesce("body", "content"))
    own = [c for c in raw.columns if c not in ("href", "url", "body", "content", "title")]
    return raw.select(*own, _text(F.col("title")).alias("title"), url.alias("url"), content.alias("content"), tier(url, F.col("title"), content).alias("tier"))


def academic_results(raw: DataFrame) -> DataFrame:
    """The common form of academic results: trimmed texts, '' and [] where nothing is given."""
    none = F.array().cast("array<string>")
    fixed = {
        **{c: _text(strip(F.col(c))) for c in ("title", "url", "content", "doi", "venue")},
        **{c: F.coalesce(F.col(c), none) for c in ("authors", "publication_types")},
    }
    return raw.withColumns(fixed)


def openalex_work(json: Column) -> Column:
    """A registry record from the JSON of an OpenAlex work."""
    def read(w: Column) -> Column:
        s = w["primary_location"]["source"]
        has = lambda x: F.coalesce(F.exists(w["indexed_in"], lambda v: F.lower(v) == x), F.lit(False))
        doaj = F.coalesce(s["is_in_doaj"], F.lit(False))
        names = F.transform(F.coalesce(w["authorships"], F.array().cast("array<struct<author:struct<display_name:string>>>")), lambda a: a["author"]["display_name"])
        return F.struct(
            clean_title(w["title"]).alias("title"), _text(w["title"]).alias("raw_title"), _text(s["display_name"]).alias("journal_name"), _text(F.get(s["issn"], F.lit(0))).alias("issn"),
            _text(s["host_organization_name"]).alias("publisher"), F.filter(names, lambda n: _text(n) != "").alias("authors"), w["publication_year"].alias("year"),
            F.coalesce(w["is_retracted"], F.lit(False)).alias("is_retracted"), doaj.alias("is_doaj"), F.coalesce(w["cited_by_count"], F.lit(0)).alias("citation_count"),
            F.array_compact(F.array(
                F.lit("OpenAlex (DOI record found)"), F.when(has("crossref"), "CrossRef (Indexed Work)"), F.when(has("pubmed") | (_text(w["ids"]["pmid"]) != ""), "PubMed / MEDLINE"),
                F.when(doaj, "DOAJ (Directory of Open Access Journals)"), F.when(has("dblp"), "DBLP (Computer Science Bibliography)"))).alias("indexed_in"),
        )
    return let(F.from_json(json, OPENALEX), read)


def crossref_work(json: Column) -> Column:
    """A registry record from the JSON of a Crossref work; a retraction shows in its updates, assertions or type."""
    def read(w: Column) -> Column:
        first = lambda a: _text(F.get(a, F.lit(0)))
        said = lambda x, a, b: F.lower(F.coalesce(F.when(x[a] != "", x[a]), x[b], F.lit("")))
        update = lambda c: F.coalesce(F.exists(w[c], lambda u: said(u, "type", "label").rlike("retraction|withdrawal|retracted")), F.lit(False))
        claim = F.coalesce(F.exists(w["assertion"], lambda u: said(u, "name", "label").rlike("retraction|retracted")), F.lit(False))
        whole = lambda a: F.trim(F.concat_ws(" ", F.when(a["given"] != "", a["given"]), F.when(a["family"] != "", a["family"])))
        people = F.transform(F.coalesce(w["author"], F.array().cast("array<struct<given:string,family:string,name:string>>")), lambda a: F.when(whole(a) != "", whole(a)).otherwise(_text(a["name"])))
        return F.struct(
            clean_title(F.get(w["title"], F.lit(0))).alias("title"), first(w["title"]).alias("raw_title"), first(w["container-title"]).alias("journal_name"), first(w["ISSN"]).alias("issn"),
            _text(w["publisher"]).alias("publisher"), F.filter(people, lambda n: n != "").alias("authors"), F.get(F.get(w["issued"]["date-parts"], F.lit(0)), F.lit(0)).alias("year"),
            (update("update-to") | update("updated-by") | claim | F.contains(F.lower(_text(w["type"])), F.lit("retraction"))).alias("is_retracted"),
            F.array(F.lit("CrossRef (Official DOI Registrar)")).alias("indexed_in"),
        )
    return let(F.from_json(json, CROSSREF), read)


def with_best_content(sources: DataFrame) -> DataFrame:
    """``content`` and ``text_origin`` from ``full_text``, else (for short contents with a DOI) ``registry_abstract``, else what there is.

    A short content with a DOI whose abstract is missing keeps no origin.
    """
    has_doi = _text(F.col("doi")) != ""
    full = has_doi & (_text(F.col("full_text")) != "")
    short = has_doi & (F.length(strip(_text(F.col("content")))) < 200)
    found = short & (_text(F.col("registry_abstract")) != "")
    origin = (
        F.when(full, "full_text").when(found, "openalex_abstract").when(short, None).when(_text(F.col("content")) != "", "search_abstract").otherwise("none")
    )
    return sources.withColumn("text_origin", origin).withColumn("content", F.when(full, F.col("full_text")).when(found, F.col("registry_abstract")).otherwise(F.col("content")))


def retraction_reason(openalex: Column, crossref: Column) -> Column:
    """Why a paper counts as retracted; '' if it doesn't."""
    return F.concat_ws("; ", F.when(openalex, "OpenAlex / Retraction Watch flagged paper as RETRACTED"), F.when(crossref, "Crossref record flags publication as RETRACTED"))


def gap_and_query(answer: Column, topic: Column) -> Column:
    """``gap`` and ``query`` of an answer's last lines of each kind; a query of one or two words gets the topic's first three long words before it."""
    lines = F.split(answer, "\n")
    last = lambda mark: strip(F.substring(F.coalesce(F.try_element_at(F.filter(lines, lambda x: F.startswith(x, F.lit(mark))), F.lit(-1)), F.lit(mark)), len(mark) + 1, 1_000_000))
    key = F.array_join(F.slice(F.filter(F.split(one_line(topic), " "), lambda w: F.length(w) > 3), 1, 3), " ")
    anchored = let(last("QUERY:"), lambda q: F.when((q != "") & (F.size(F.split(one_line(q), " ")) <= 2), F.concat(key, F.lit(" "), q)).otherwise(q))
    return F.struct(last("GAP:").alias("gap"), anchored.alias("query"))


def follow_up(query: Column, topic: Column) -> Column:
    """A follow-up query that begins with the topic's first four words unless it contains them."""
    head = F.array_join(F.slice(F.split(one_line(topic), " "), 1, 4), " ")
    return F.when((query != "") & ~F.contains(F.lower(query), F.lower(head)), F.concat(head, F.lit(" "), query)).otherwise(query)


def first_sentences(c: Column, n: int = 2, limit: int = 300) -> Column:
    """The first sentences without tags, cut at a word."""
    from attesta.functions.text import cut_cell

    plain = one_line(F.regexp_replace(c, "<[^>]+>", " "))
    return F.when(plain == "", "").otherwise(cut_cell(F.array_join(F.slice(F.split(plain, r"(?<=[.!?])\s+"), 1, n), " "), limit))


def accepted_extractions(items: DataFrame, sources: DataFrame, least_words: int = 6) -> DataFrame:
    """Extracted ``(item_id, source_id, evidence, claim)`` whose source is known, whose quotation is in it (or is replaced by the passage it quotes) and whose claim is long enough.

    Containment is decided by built-ins; only the rest goes through character matching.
    """
    known = items.join(sources.select("source_id", "content"), "source_id")
    words = F.size(F.filter(F.split(one_line(_text(F.col("claim"))), " "), lambda w: w != ""))
    known = known.where(words >= least_words)
    e, c = one_line(_text(F.col("evidence"))), one_line(_text(F.col("content")))
    inside = (e != "") & F.contains(c, e)
    cols = ["item_id", "source_id", "evidence", "claim"]
    sure = known.where(inside).select(*cols)
    rest = quotes.with_recovered(known.where(~inside), "evidence", "content", "evidence").where(F.col("evidence").isNotNull()).select(*cols)
    return sure.unionByName(rest)


def unconfirmed(verdicts: DataFrame) -> DataFrame:
    """Verdicts that do not support their claim, with how they are shown."""
    label = F.upper(F.coalesce(blank_to_null(F.col("label")), F.lit("UNVERIFIED")))
    shown = F.when(label == "CONTRADICTION", "❌").when(label == "NEUTRAL", "⚠️").otherwise("ℹ️")
    return verdicts.withColumn("label", label).where((F.col("label") != "ENTAILMENT") & (F.length(strip(_text(F.col("claim")))) >= 5)).withColumn("icon", shown)
