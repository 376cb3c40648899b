"""Keys that decide which records are the same; each variant has its own meaning and is kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import blank_to_null, let, one_line, strip


def _no_slash(c: Column) -> Column:
    return F.regexp_replace(c, "/+$", "")


def source_key(doi: Column, url: Column, title: Column) -> Column:
    """Digest of the first of DOI, address and title that is given; '' if none is. Resolver prefixes are not removed."""
    first = F.coalesce(F.when(doi != "", doi), F.when(url != "", url), F.when(title != "", title))
    return let(_no_slash(F.lower(strip(first))), lambda ident: F.when(ident != "", F.concat(F.lit("src_"), F.substring(F.sha2(ident, 256), 1, 16))).otherwise(F.lit("")))


def evidence_id(key: Column, evidence: Column, claim: Column) -> Column:
    raw = F.concat(F.coalesce(key, F.lit("")), F.lit("\n"), one_line(F.coalesce(evidence, F.lit(""))), F.lit("\n"), one_line(F.coalesce(claim, F.lit(""))))
    return F.concat(F.lit("ev_"), F.substring(F.sha2(raw, 256), 1, 16))


def report_doi(c: Column) -> Column:
    """As reports cite: lower case, no resolver or label, no slash at the end."""
    return _no_slash(F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", ""))


def literature_doi(c: Column) -> Column:
    """As literature is compared: no resolver or label, no closing marks, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?i)^(https?://doi\.org/|doi:)", ""), "[.,;:)\"']+$", ""))


def dedup_doi(c: Column) -> Column:
    """As search results are merged: no resolver or label, lower case."""
    return F.lower(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?i)^(https?://doi\.org/|doi:)", ""))


def canonical_id(doi: Column, url: Column, title: Column) -> Column:
    """``doi:``, else ``url:``, else ``title:``; NULL if nothing is given."""
    d = F.lower(strip(F.coalesce(doi, F.lit(""))))
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)doi\.org/(10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+)", 1))
    d = F.when(d != "", d).otherwise(found)
    d = _no_slash(F.trim(F.regexp_replace(d, r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")))
    u = _no_slash(F.lower(strip(F.coalesce(url, F.lit("")))))
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))
    return F.when(d != "", F.concat(F.lit("doi:"), d)).when(u != "", F.concat(F.lit("url:"), u)).when(t != "", F.concat(F.lit("title:"), t))


def url_host(url: Column) -> Column:
    """Host in lower case without credentials and port; '' if there is none."""
    authority = F.regexp_extract(strip(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))


def _query(url: Column, drop: str) -> Column:
    q = F.regexp_extract(strip(url), r"^[^?#]*\?([^#]*)", 1)
    parts = F.filter(F.split(q, "&"), lambda p: p.rlike("^[^=]+=.") & ~F.lower(p).rlike(drop))
    return F.array_join(parts, "&")


def _url(url: Column, authority: Column, drop: str) -> Column:
    u = strip(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    path = let(_no_slash(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)), lambda x: F.when(x == "", F.lit("/")).otherwise(x))
    tail = let(_query(url, drop), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    return let(authority, lambda a: F.when(u == "", F.lit("")).when(a != "", F.concat(scheme, F.lit("://"), a, path, tail)).otherwise(_no_slash(F.lower(u))))


def web_url(url: Column) -> Column:
    """Search results: no port, credentials, fragment, tracking parameters, parameters without value and slash at the end."""
    return _url(url, url_host(url), r"^(utm_[^=]*|ref|source|fbclid|gclid)=")


def research_url(url: Column) -> Column:
    """Research sources: like search results, but with port and credentials, and only ``utm_`` parameters dropped."""
    return _url(url, F.lower(F.regexp_extract(strip(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^utm_[^=]*=")


def report_url(url: Column) -> Column:
    """Reports: scheme and host in lower case, no query and fragment; what has no scheme is read as a DOI."""
    u = strip(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = _no_slash(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    return F.when(u == "", F.lit("")).when(scheme != "", F.concat(scheme, F.lit("://"), host, path)).otherwise(F.concat(F.lit("https://doi.org/"), report_doi(u)))


def aliases(doi: Column, url: Column) -> Column:
    """The identifiers that connect equal sources in a report, the DOI first."""

    def both(u: Column) -> Column:
        own = let(report_doi(doi), lambda d: F.when(d != "", d).otherwise(let(report_doi(u), lambda x: F.when((u != "") & (x != "") & (x != u), x).otherwise(F.lit("")))))
        return let(own, lambda d: F.array_compact(F.array(F.when(d != "", F.concat(F.lit("doi:"), d)), F.when(u != "", F.concat(F.lit("url:"), u)))))

    return let(report_url(url), both)


def cache_key(query: Column, n: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lower(strip(query)), F.lit("|"), n.cast("string")), 256), 1, 16)


def blank(c: Column) -> Column:
    return blank_to_null(c)
