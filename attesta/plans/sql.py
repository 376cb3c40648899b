"""SQL for DuckDB with the rows and columns of the core queries."""

from __future__ import annotations

import html

from attesta.functions import lexicon as lx
from attesta.plans import render
from attesta.plans.core import HOSTS, NOW, TOPIC

SQL: dict[str, str] = {}

_SP = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_lit(x) for x in xs) + "]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def _line(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SP}+', ' ', 'g'))"


def _no_slash(x: str) -> str:
    return f"regexp_replace({x}, '/+$', '')"


def _source_key(doi: str, url: str, title: str) -> str:
    ident = _no_slash(f"lower({_strip(f'coalesce(nullif({doi}, {chr(39) * 2}), nullif({url}, {chr(39) * 2}), nullif({title}, {chr(39) * 2}))')})")
    return f"CASE WHEN {ident} <> '' THEN 'src_' || substr(sha256({ident}), 1, 16) ELSE '' END"


def _report_doi(x: str) -> str:
    return _no_slash(f"regexp_replace(lower({_strip(f'coalesce({x}, {chr(39) * 2})')}), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', '')")


def _literature_doi(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace({_strip(f'coalesce({x}, {chr(39) * 2})')}, '(?i)^(https?://doi\\.org/|doi:)', ''), '[.,;:)\"'']+$', ''))"


def _dedup_doi(x: str) -> str:
    return f"lower(regexp_replace({_strip(f'coalesce({x}, {chr(39) * 2})')}, '(?i)^(https?://doi\\.org/|doi:)', ''))"


_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*)://"
_AUTH = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def _host(u: str) -> str:
    return f"lower(regexp_replace(regexp_replace(regexp_extract({_strip(u)}, '{_AUTH}', 1), '^.*@', ''), ':[0-9]*$', ''))"


def _url(u: str, authority: str, drop: str) -> str:
    s = _strip(u)
    path = _no_slash(f"regexp_extract({s}, '{_PATH}', 1)")
    q = f"array_to_string(list_filter(string_split(regexp_extract({s}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.') AND NOT regexp_matches(lower(p), '{drop}')), '&')"
    full = f"lower(regexp_extract({s}, '{_SCHEME}', 1)) || '://' || {authority} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END"
    return f"CASE WHEN {s} = '' THEN '' WHEN {authority} <> '' THEN {full} ELSE {_no_slash(f'lower({s})')} END"


def _web_url(u: str) -> str:
    return _url(u, _host(u), "^(utm_[^=]*|ref|source|fbclid|gclid)=")


def _report_url(u: str) -> str:
    s = _strip(f"coalesce({u}, '')")
    scheme = f"lower(regexp_extract({s}, '{_SCHEME}', 1))"
    path = _no_slash(f"regexp_extract({s}, '{_PATH}', 1)")
    return f"CASE WHEN {s} = '' THEN '' WHEN {scheme} <> '' THEN {scheme} || '://' || lower(regexp_extract({s}, '{_AUTH}', 1)) || {path} ELSE 'https://doi.org/' || {_report_doi(s)} END"


def _canonical(doi: str, url: str, title: str) -> str:
    d0 = f"lower({_strip(f'coalesce({doi}, {chr(39) * 2})')})"
    found = f"lower(regexp_extract(coalesce({url}, ''), '(?i)doi\\.org/(10\\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9]+)', 1))"
    d = _no_slash(f"trim(regexp_replace(CASE WHEN {d0} <> '' THEN {d0} ELSE {found} END, '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', ''))")
    u = _no_slash(f"lower({_strip(f'coalesce({url}, {chr(39) * 2})')})")
    t = f"trim(regexp_replace(lower(coalesce({title}, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
    return f"CASE WHEN {d} <> '' THEN 'doi:' || {d} WHEN {u} <> '' THEN 'url:' || {u} WHEN {t} <> '' THEN 'title:' || {t} END"


def _terms(x: str, least: int, cls: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '([\\p{{L}}\\p{{N}}\\p{{M}}_]+)', 1), lambda w: regexp_full_match(w, '[{cls}]{{{least},}}'))"


def _distinct(x: str) -> str:
    return f"list_distinct({x})"


def _keywords(x: str) -> str:
    return _distinct(f"list_filter({_terms(x, 3, 'a-z')}, lambda w: NOT list_contains({_list(lx.CLAIM_STOP_WORDS)}, w))")


def _words(x: str) -> str:
    return _distinct(f"regexp_extract_all(lower({x}), '([\\p{{L}}\\p{{N}}_]+)', 1)")


def _title_form(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"


_MADE_URL = (
    f"'HTTPS://' || list_extract({_list(HOSTS)}, CAST(rec_id % {len(HOSTS)} + 1 AS INT)) || CASE WHEN rec_id % 20 = 8 THEN '/wiki/Network' ELSE '/p/' || (rec_id % 977) END || "
    "CASE WHEN rec_id % 3 = 0 THEN '/?utm_source=x&page=' || (rec_id % 4) || '&ref=a#top' WHEN rec_id % 3 = 1 THEN '/' ELSE '?q=&id=7' END"
)
_LATEST = "(SELECT * FROM profiles QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY checked_at DESC, profile_id DESC) = 1)"


def _any(text: str, parts) -> str:
    return "(" + " OR ".join(f"contains({text}, {_lit(p)})" for p in parts) + ")"


def _on(host: str, domains) -> str:
    return f"len(list_filter({_list(domains)}, lambda m: {host} = m OR ends_with({host}, '.' || m))) > 0"


def _trusted(u: str) -> str:
    return "(" + " OR ".join(f"ends_with({_host(u)}, {_lit(s)})" for s in lx.TRUSTED_SUFFIXES) + f" OR {_on(_host(u), lx.TRUSTED_DOMAINS)})"


def _junk(u: str) -> str:
    slug = f"regexp_replace(list_extract(string_split(lower({u}), 'wikipedia.org/wiki/'), -1), '^/+|/+$', '', 'g')"
    return (
        f"({_host(u)} = '' OR {_any(_host(u), lx.ADULT_HOST_PARTS)} OR {_on(_host(u), lx.JUNK_DOMAINS)} OR {_any('lower(coalesce(title, ' + chr(39) * 2 + '))', lx.JUNK_TITLES)} "
        f"OR (NOT {_trusted(u)} AND {_any('lower(coalesce(content, ' + chr(39) * 2 + '))', lx.SHOP_CONTENTS)}) OR (contains(lower({u}), 'wikipedia.org/wiki/') AND list_contains({_list(lx.WIKI_SLUGS)}, {slug})))"
    )


def _tier(u: str) -> str:
    return f"CAST(CASE WHEN {_junk(u)} THEN 3 WHEN {_trusted(u)} THEN 1 ELSE 2 END AS BIGINT)"


SQL["k_source_keys"] = f"SELECT rec_id, {_source_key('doi', 'url', 'title')} AS source_key FROM academic_sources"
SQL["k_evidence_ids"] = (
    f"SELECT item_id, 'ev_' || substr(sha256(coalesce(source_key, '') || chr(10) || {_line('coalesce(evidence, ' + chr(39) * 2 + ')')} || chr(10) || {_line('coalesce(claim, ' + chr(39) * 2 + ')')}), 1, 16) AS made_id FROM evidence_items"
)
SQL["k_canonical_ids"] = f"SELECT rec_id, {_canonical('doi', 'url', 'title')} AS canonical_id FROM academic_sources"
SQL["k_doi_forms"] = f"SELECT rec_id, {_report_doi('doi')} AS report_doi, {_literature_doi('doi')} AS literature_doi, {_dedup_doi('doi')} AS dedup_doi FROM academic_sources"
_RESEARCH_AUTH = f"lower(regexp_extract({_strip('u')}, '{_AUTH}', 1))"
SQL["k_urls"] = (
    f"SELECT rec_id, {_web_url('u')} AS web_url, {_url('u', _RESEARCH_AUTH, '^utm_[^=]*=')} AS research_url, {_report_url('u')} AS report_url, {_host('u')} AS host FROM (SELECT rec_id, {_MADE_URL} AS u FROM academic_sources)"
)
SQL["k_aliases"] = f"""
WITH a AS (SELECT rec_id, {_report_doi('doi')} AS d0, {_report_url('url')} AS u FROM academic_sources),
b AS (SELECT rec_id, u, CASE WHEN d0 <> '' THEN d0 WHEN u <> '' AND {_report_doi('u')} <> '' AND {_report_doi('u')} <> u THEN {_report_doi('u')} ELSE '' END AS d FROM a),
c AS (SELECT rec_id, list_filter([CASE WHEN d <> '' THEN 'doi:' || d END, CASE WHEN u <> '' THEN 'url:' || u END], lambda x: x IS NOT NULL) AS l FROM b)
SELECT rec_id, n - 1 AS n, l[n] AS alias FROM c, unnest(range(1, len(l) + 1)) t(n)
"""
SQL["k_cache_keys"] = f"SELECT rec_id, substr(sha256(lower({_strip('coalesce(title, ' + chr(39) * 2 + ')')}) || '|8'), 1, 16) AS cache_key FROM academic_sources"

_SENT = f"list_filter(list_transform(string_split(regexp_replace({_strip('content')}, '([.!?]){_SP}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_line('s')}), lambda s: s <> '')"
SQL["t_sentences"] = f"WITH a AS (SELECT rec_id, {_SENT} AS l FROM academic_sources WHERE content IS NOT NULL) SELECT rec_id, n - 1 AS n, l[n] AS sentence FROM a, unnest(range(1, len(l) + 1)) t(n)"
_PROT = f"regexp_replace(regexp_replace(regexp_replace({_strip('content')}, '(?i)\\b(e)\\.(g)\\.', '\\1' || chr(57344) || '\\2' || chr(57344), 'g'), '(?i)\\b(i)\\.(e)\\.', '\\1' || chr(57344) || '\\2' || chr(57344), 'g'), '(?i)\\b(figs?|eqs?|refs?)\\.', '\\1' || chr(57344), 'g')"
_PARTS = f"list_filter(list_transform(string_split(regexp_replace({_PROT}, '([.!?]){_SP}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: replace({_strip('s')}, chr(57344), '.')), lambda s: s <> '')"
_WINDOWS = f"""parts AS (SELECT rec_id, {_PARTS} AS s FROM academic_sources WHERE content IS NOT NULL),
win AS (SELECT rec_id, n - 1 AS n, array_to_string(list_slice(s, n, n + 1), ' ') AS passage FROM parts, unnest(range(1, greatest(len(s) - 1, 1) + 1)) t(n) WHERE len(s) > 0)"""
SQL["t_windows"] = f"WITH {_WINDOWS} SELECT rec_id, n, passage FROM win"
SQL["t_keywords"] = f"SELECT item_id, array_to_string(list_sort({_keywords('claim')}), ' ') AS keywords FROM evidence_items WHERE claim IS NOT NULL"
SQL["t_title_forms"] = f"SELECT rec_id, {_title_form('title')} AS title_form, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS word_form FROM academic_sources WHERE title IS NOT NULL"
SQL["t_author_lines"] = """
SELECT rec_id, CASE WHEN len(l) = 0 THEN 'N/A' ELSE trim(translate(array_to_string(list_slice(l, 1, 3), ', ') || CASE WHEN len(l) > 3 THEN ' et al.' ELSE '' END, '|' || chr(10), '/ ')) END AS line
FROM (SELECT rec_id, list_filter(coalesce(authors, []), lambda n: n IS NOT NULL AND n <> '') AS l FROM academic_sources)
"""
_HIGH = "".join(html.unescape(f"&#{n};") or " " for n in range(128, 160))


def _unescape(x: str) -> str:
    """The named character references that occur in the test tables, and all decimal ones, read twice."""
    n = "CAST(regexp_extract(p, '^([0-9]{1,6});', 1) AS INT)"
    for _ in range(2):
        number = f"CASE WHEN {n} BETWEEN 128 AND 159 THEN substr({_lit(_HIGH)}, {n} - 127, 1) ELSE chr({n}) END"
        x = f"array_to_string(list_transform(string_split({x}, '&#'), lambda p, i: CASE WHEN i > 1 AND regexp_matches(p, '^[0-9]{{1,6}};') THEN {number} || regexp_replace(p, '^[0-9]+;', '') WHEN i > 1 THEN '&#' || p ELSE p END), '')"
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
            x = f"replace({x}, {_lit(entity)}, {_lit(char)})"
    return x


SQL["t_cells"] = f"SELECT doc_id, CASE WHEN length(t) > 80 THEN regexp_replace(substr(t, 1, 80), ' [^ ]*$', '') || '…' ELSE t END AS cell FROM (SELECT doc_id, {_strip(f"translate({_unescape('text')}, '|' || chr(10), '/ ')")} AS t FROM documents WHERE text IS NOT NULL)"
_CLEAN = _line(
    "regexp_replace(regexp_replace(regexp_replace(" + _strip("substr('QUERY: \"' || claim || '\"', 7)") + ", '^[\"''`]+|[\"''`]+$', '', 'g'), '\\b(AND|OR|NOT)\\b', ' ', 'g'), '[()\\[\\]{}:;?,\\n\\r]', ' ', 'g')"
)
SQL["t_queries"] = f"""
WITH a AS (SELECT item_id, string_split({_CLEAN}, ' ') AS w FROM evidence_items WHERE claim IS NOT NULL),
b AS (SELECT item_id, w, list_filter(w, lambda x: NOT list_contains({_list(lx.QUERY_STOP_WORDS)}, lower(x))) AS k FROM a)
SELECT item_id, CASE WHEN len(w) <= 7 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(CASE WHEN len(k) >= 3 THEN k ELSE w END, 1, 7), ' ') END AS cleaned FROM b
"""
SQL["t_key_passages"] = f"""
WITH a AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '(?is)\\n#+\\s*(references|bibliography)\\b.*$', ''), '\\s+', ' ', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, n, s[n] AS t, len(regexp_extract_all(s[n], {_lit('(?i)' + lx.FINDING_CUES)})) AS c FROM a, unnest(range(1, len(s) + 1)) x(n) WHERE length(s[n]) > 40 AND length(s[n]) < 400),
c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, n) <= 12),
e AS (SELECT * FROM c QUALIFY c > 0 OR max(c) OVER (PARTITION BY doc_id) = 0)
SELECT d.doc_id, coalesce(substr(string_agg(t, ' ' ORDER BY n), 1, 3500), '') AS passages FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) d LEFT JOIN e ON d.doc_id = e.doc_id GROUP BY d.doc_id
"""
SQL["t_inverted_index"] = f"SELECT rec_id, {_line('content')} AS content FROM academic_sources WHERE content IS NOT NULL"
SQL["t_title_overlap"] = f"""
WITH a AS (SELECT run_id, pos, {_words("coalesce(title, '')")} AS a, {_words("coalesce(lag(title) OVER (PARTITION BY run_id ORDER BY pos), '')")} AS b FROM academic_sources)
SELECT run_id, pos, round({_jaccard('a', 'b')}, 6) AS overlap FROM a
"""

_MADE = f"(SELECT *, {_MADE_URL} AS u FROM academic_sources)"
SQL["s_tiers"] = f"SELECT rec_id, {_tier('u')} AS tier, {_junk('u')} AS junk FROM {_MADE}"
SQL["s_tier_ranks"] = f"SELECT run_id, rec_id, tier, row_number() OVER (PARTITION BY run_id ORDER BY tier, pos) AS rank FROM (SELECT run_id, rec_id, pos, {_tier('u')} AS tier FROM {_MADE})"
_TYPES = "list_transform(coalesce(publication_types, []), lambda t: lower(t))"
_BOTH = "(lower(coalesce(venue, '')) || ' ' || lower(coalesce(url, '')))"
SQL["s_types"] = (
    f"SELECT rec_id, CASE WHEN list_has_any({_TYPES}, ['journalarticle', 'journal-article']) THEN 'journal' WHEN list_has_any({_TYPES}, ['conferencepaper', 'proceedings-article']) THEN 'conference' "
    f"WHEN list_has_any({_TYPES}, ['preprint', 'posted-content']) THEN 'preprint' WHEN list_has_any({_TYPES}, ['report', 'techreport']) THEN 'report' WHEN {_any(_BOTH, lx.PREPRINT_WORDS)} THEN 'preprint' "
    f"WHEN {_any(_BOTH, lx.CONFERENCE_WORDS)} THEN 'conference' WHEN coalesce(venue, '') <> '' THEN 'journal' ELSE 'report' END AS source_type FROM academic_sources"
)


def _relevant(least: int, stop) -> str:
    words = [w for w in dict.fromkeys(__import__("re").findall("[a-z0-9]{3,}", TOPIC.lower())) if w not in stop]
    text = "lower(coalesce(title, '') || ' ' || coalesce(content, ''))"
    hit = " + ".join(f"CAST(contains({text}, {_lit(w)}) AS INT)" for w in words)
    return f"SELECT run_id, rec_id FROM (SELECT run_id, rec_id, {hit} >= {min(least, len(words))} AS good FROM academic_sources) QUALIFY good OR NOT bool_or(good) OVER (PARTITION BY run_id)"


SQL["s_relevant"] = _relevant(2, lx.LITERATURE_STOP_WORDS)
SQL["s_relevant_loose"] = _relevant(1, lx.TOPIC_STOP_WORDS)
SQL["s_usable"] = "SELECT run_id, rec_id FROM academic_sources QUALIFY coalesce(content, '') <> '' OR NOT bool_or(coalesce(content, '') <> '') OVER (PARTITION BY run_id)"
SQL["s_no_supplements"] = "SELECT rec_id FROM academic_sources WHERE NOT ends_with(lower(coalesce(CASE WHEN rec_id % 11 = 0 THEN url || '/MM1' ELSE url END, '')), '/mm1') AND NOT ends_with(lower(coalesce(title, '')), '.pdf')"
SQL["s_metadata_scores"] = """
SELECT rec_id, CAST((coalesce(title, '') <> '')::INT + 2 * (len(coalesce(authors, [])) > 0)::INT + (year IS NOT NULL)::INT + 2 * (coalesce(doi, '') <> '')::INT + 2 * (coalesce(content, '') <> '')::INT + (coalesce(url, '') <> '')::INT AS BIGINT) AS score
FROM academic_sources
"""

SQL["d_web"] = f"SELECT run_id, rec_id, tier FROM (SELECT run_id, rec_id, pos, {_tier('u')} AS tier, {_web_url('u')} AS c FROM {_MADE}) WHERE tier < 3 QUALIFY row_number() OVER (PARTITION BY run_id, c ORDER BY pos) = 1"
SQL["d_capped"] = f"""
WITH a AS (SELECT run_id, rec_id, pos FROM academic_sources QUALIFY row_number() OVER (PARTITION BY run_id, lower({_strip("coalesce(url, '')")}) ORDER BY pos) = 1)
SELECT run_id, rec_id FROM a QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY pos) <= 8
"""
SQL["d_doi"] = f"SELECT run_id, rec_id FROM (SELECT *, {_literature_doi('doi')} AS k FROM academic_sources) QUALIFY k = '' OR row_number() OVER (PARTITION BY run_id, k ORDER BY pos) = 1"

SQL["j_profiles"] = f"SELECT s.run_id, s.pos, s.rec_id, p.doi_verified, p.is_retracted, p.identity_status, p.authors_match, p.journal_name FROM academic_sources s LEFT JOIN {_LATEST} p ON s.rec_id = p.rec_id"
SQL["j_evidence_sources"] = """
WITH b AS (SELECT rec_id, url FROM academic_sources UNION ALL SELECT rec_id, url FROM pinned_sources),
u AS (SELECT url, min(rec_id) AS rec_id FROM b WHERE url <> '' GROUP BY url)
SELECT e.item_id, coalesce(i.rec_id, u.rec_id, 0) AS rec_id FROM evidence_items e
LEFT JOIN b i ON e.item_id % 7 <> 0 AND e.source_id = 'source_' || i.rec_id LEFT JOIN u ON u.url = e.source_url
"""
_CL = f"nullif(lower({_line('coalesce(claim, ' + chr(39) * 2 + ')')}), '')"


def _level(k: str, value: str) -> str:
    return f"(SELECT k, {value} FROM (SELECT *, {k} AS k FROM verdicts) WHERE k IS NOT NULL GROUP BY k)"


_PAIR = f"nullif(source_key, '') || chr(10) || {_CL}"
_LAST = "arg_max({'label': label, 'confidence': confidence}, verdict_id) AS v"
_LAST_LABELS = f"""
(SELECT e.*, coalesce(a.v, b.v, c.v).label AS last_label, coalesce(a.v, b.v, c.v).confidence AS last_confidence
 FROM (SELECT *, nullif(evidence_id, '') AS k1, {_PAIR} AS k2, {_CL} AS k3 FROM evidence_items) e
 LEFT JOIN {_level("nullif(evidence_id, '')", _LAST)} a ON e.k1 = a.k LEFT JOIN {_level(_PAIR, _LAST)} b ON e.k2 = b.k LEFT JOIN {_level(_CL, _LAST)} c ON e.k3 = c.k)
"""
SQL["j_last_labels"] = f"SELECT item_id, last_label AS label, last_confidence AS confidence FROM {_LAST_LABELS}"
_CS = f"nullif({_strip('coalesce(claim, ' + chr(39) * 2 + ')')}, '')"
_UU = f"nullif({_report_url('source_url')}, '')"
_AGREE = "CASE WHEN count(DISTINCT upper(coalesce(nullif(label, ''), 'UNVERIFIED'))) = 1 THEN min(upper(coalesce(nullif(label, ''), 'UNVERIFIED'))) ELSE 'UNVERIFIED' END AS v"
SQL["j_agreed_labels"] = f"""
SELECT e.item_id, coalesce(a.v, b.v, c.v, d.v, 'UNVERIFIED') AS label
FROM (SELECT *, nullif(evidence_id, '') AS k1, nullif(source_key, '') || chr(10) || {_CS} AS k2, {_UU} || chr(10) || {_CS} AS k3, {_CS} AS k4 FROM evidence_items) e
LEFT JOIN {_level("nullif(evidence_id, '')", _AGREE)} a ON e.k1 = a.k
LEFT JOIN {_level("nullif(source_key, '') || chr(10) || " + _CS, _AGREE)} b ON e.k2 = b.k
LEFT JOIN {_level(_UU + " || chr(10) || " + _CS, _AGREE)} c ON e.k3 = c.k LEFT JOIN {_level(_CS, _AGREE)} d ON e.k4 = d.k
"""
SQL["j_not_contradicted"] = """
WITH v AS (SELECT claim, arg_max(label, verdict_id) AS last FROM verdicts WHERE claim <> '' GROUP BY claim),
x AS (SELECT e.source_id, e.item_id, coalesce(v.last, '') <> 'CONTRADICTION' AS good FROM evidence_items e LEFT JOIN v ON e.claim = v.claim)
SELECT source_id, item_id FROM x QUALIFY good OR NOT bool_or(good) OVER (PARTITION BY source_id)
"""
SQL["j_new_works"] = f"SELECT work_id FROM registry_works WHERE {_report_doi('doi')} <> '' AND {_report_doi('doi')} NOT IN (SELECT {_report_doi('doi')} FROM academic_sources)"
_NAMED = "list_transform(regexp_extract_all(t, '(?i)(10\\.[0-9]{4,9}/[^\\s\"<>()\\[\\]]+)', 1), lambda x: " + _literature_doi("x") + ")"
_RUNS = """
allsrc AS (SELECT rec_id, run_id, CAST(pos AS BIGINT) AS pos, doi, url, title, content FROM academic_sources),
pin AS (SELECT rec_id, doi, url, title, content FROM pinned_sources),
rsrc AS (
  SELECT * FROM allsrc
  UNION ALL SELECT p.rec_id, r.run_id, 1099511627776 + p.rec_id AS pos, p.doi, p.url, p.title, p.content FROM (SELECT DISTINCT run_id FROM allsrc WHERE run_id IS NOT NULL UNION ALL SELECT 'pinned') r CROSS JOIN pin p),
ev AS (SELECT e.*, x.rec_id, x.run_id, x.doi AS sdoi, x.url AS surl, x.title AS stitle FROM evidence_items e JOIN (SELECT rec_id, run_id, doi, url, title FROM allsrc UNION ALL SELECT rec_id, 'pinned', doi, url, title FROM pin) x ON e.source_id = 'source_' || x.rec_id)"""
SQL["j_invented_dois"] = f"""
WITH {_RUNS},
t AS (SELECT run_id, coalesce(evidence, '') || ' see ' || coalesce(doi, '') || '.' AS t FROM ev),
n AS (SELECT DISTINCT run_id, unnest({_NAMED}) AS doi FROM t),
h AS (SELECT DISTINCT run_id, {_literature_doi('doi')} AS doi FROM rsrc WHERE doi <> '')
SELECT n.run_id, n.doi FROM n ANTI JOIN h ON n.run_id = h.run_id AND n.doi = h.doi
"""
SQL["j_unverified"] = "SELECT item_id FROM evidence_items e WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.evidence_id = e.evidence_id)"
SQL["j_batches"] = "SELECT item_id, source_key, CAST(floor((row_number() OVER (PARTITION BY source_key ORDER BY item_id) - 1) / 5) AS BIGINT) AS batch FROM evidence_items"
SQL["j_merged_providers"] = "SELECT run_id, rec_id, row_number() OVER (PARTITION BY run_id ORDER BY CASE source WHEN 'Semantic Scholar' THEN 0 WHEN 'OpenAlex' THEN 1 WHEN 'Crossref' THEN 2 ELSE 3 END, pos) AS place FROM academic_sources"
_COUNT = lambda x: f"len(list_filter(regexp_split_to_array({_strip(f'coalesce({x}, {chr(39) * 2})')}, '{_SP}+'), lambda w: w <> ''))"
SQL["j_valid_gaps"] = f"""
WITH p AS (SELECT run_id, rec_id, {_words("'extending ' || title")} AS a FROM academic_sources WHERE title <> '' AND len(list_filter(regexp_split_to_array({_strip("coalesce(content, '')")}, '\\s+'), lambda w: w <> '')) >= 8),
t AS (SELECT DISTINCT run_id, {_words('title')} AS b FROM academic_sources WHERE title <> '')
SELECT rec_id FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.run_id = p.run_id AND {_jaccard('p.a', 't.b')} > 0.65)
"""


def _rate(x: str) -> str:
    return f"round({x} / nullif(count(*) FILTER (upper(label) IN ('ENTAILMENT', 'NEUTRAL', 'CONTRADICTION')), 0), 3)"


def _n(x: str) -> str:
    return f"count(*) FILTER (upper(label) = '{x}')"


SQL["a_label_summary"] = f"""
SELECT count(*) AS total, {_n('ENTAILMENT')} AS entailed, {_n('NEUTRAL')} AS neutral, {_n('CONTRADICTION')} AS contradicted,
count(*) - {_n('ENTAILMENT')} - {_n('NEUTRAL')} - {_n('CONTRADICTION')} AS unverified, {_rate(_n('ENTAILMENT'))} AS entailment_rate, {_rate(_n('CONTRADICTION'))} AS contradiction_rate,
{_rate('(' + _n('NEUTRAL') + ' + ' + _n('CONTRADICTION') + ')')} AS unsupported_or_contradicted_rate FROM verdicts
"""
SQL["a_quality_audit"] = f"SELECT count(*) AS papers, count(*) FILTER (doi_verified) AS doi_verified, count(*) FILTER (is_retracted) AS retracted, count(*) FILTER (confidence_level = 'HIGH') AS high FROM {_LATEST}"
SQL["a_claim_buckets"] = f"""
WITH f AS (SELECT source_key, upper(coalesce(last_label, 'UNVERIFIED')) AS label, claim, min(item_id) AS i FROM {_LAST_LABELS} WHERE source_key <> '' AND claim <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source_key, label ORDER BY i) AS rn FROM f)
SELECT source_key, label, count(*) AS claims, string_agg(claim, ' / ' ORDER BY rn) FILTER (rn <= 3) AS shown FROM r GROUP BY source_key, label
"""
SQL["a_indexes"] = """
SELECT e.source_key, coalesce(x.indexes, '') AS indexes, e.retracted FROM (SELECT source_key, count(*) FILTER (is_retracted) AS retracted FROM evidence_items GROUP BY source_key) e
LEFT JOIN (SELECT source_key, string_agg(DISTINCT v, '; ' ORDER BY v) AS indexes FROM (SELECT source_key, unnest(verified_indexes) AS v FROM evidence_items) GROUP BY source_key) x ON e.source_key IS NOT DISTINCT FROM x.source_key
"""

_REG = f"""
p AS (SELECT *, nullif({_report_doi('doi')}, '') AS k FROM academic_sources),
w AS (SELECT *, {_report_doi('doi')} AS k FROM registry_works WHERE {_report_doi('doi')} <> '' QUALIFY row_number() OVER (PARTITION BY registry, {_report_doi('doi')} ORDER BY work_id) = 1),
t AS (SELECT p.*, o.work_id AS oa_id, o.title AS oa_title, o.authors AS oa_authors, o.container_title AS oa_journal, c.work_id AS cr_id, c.title AS cr_title, c.authors AS cr_authors, c.container_title AS cr_journal
      FROM p LEFT JOIN w o ON p.k = o.k AND o.registry = 'openalex' LEFT JOIN w c ON p.k = c.k AND c.registry = 'crossref')"""


def _status(idc: str, n: int) -> str:
    m = f"(rec_id + {n}) % 5"
    return f"CASE WHEN {idc} IS NOT NULL THEN 'VERIFIED' WHEN {m} = 0 THEN 'RATE_LIMITED' WHEN {m} = 1 THEN 'UNAVAILABLE' WHEN {m} = 2 THEN 'TIMEOUT' ELSE 'NOT_FOUND' END"


SQL["r_statuses"] = f"WITH {_REG} SELECT rec_id, {_status('oa_id', 0)} AS oa_status, {_status('cr_id', 2)} AS cr_status FROM t"


def _ct(x: str) -> str:
    out = f"coalesce({x}, '')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, {_lit(entity)}, {_lit(char)})"
    return f"trim(regexp_replace(regexp_replace(lower(regexp_replace({out}, '<[^>]+>', ' ', 'g')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _tok(c: str) -> str:
    kept = f"list_filter(string_split({c}, ' '), lambda w: NOT list_contains({_list(lx.TITLE_STOP_WORDS)}, w))"
    return f"list_distinct(CASE WHEN len({kept}) > 0 THEN {kept} ELSE string_split({c}, ' ') END)"


def _tsim(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE {_jaccard(_tok(a), _tok(b))} END"


def _fam(x: str) -> str:
    return f"list_extract(regexp_split_to_array(trim(lower(CASE WHEN contains({x}, ',') THEN split_part({x}, ',', 1) ELSE {x} END)), '\\s+'), -1)"


def _overlap(a: str, b: str) -> str:
    na, nb = (f"list_filter(list_transform({x}, lambda q: {_fam('q')}), lambda q: q <> '')" for x in (a, b))
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL OR len({na}) = 0 OR len({nb}) = 0 THEN NULL WHEN {_fam(a + '[1]')} <> '' AND {_fam(b + '[1]')} <> '' AND {_fam(a + '[1]')} <> {_fam(b + '[1]')} THEN false ELSE list_has_any({na}, {nb}) END"
    )


_DECIDED = f"""
WITH {_REG},
a AS (SELECT *, {_status('oa_id', 0)} AS oa, {_status('cr_id', 2)} AS cr, {_ct('title')} AS ct, {_ct('oa_title')} AS co, {_ct('cr_title')} AS cc, {_ct('oa_journal')} AS jo, {_ct('cr_journal')} AS jc,
      {_overlap('oa_authors', 'cr_authors')} AS ab, {_overlap('authors', 'oa_authors')} AS ao, {_overlap('authors', 'cr_authors')} AS ac, len(coalesce(authors, [])) > 0 AS has,
      coalesce(oa_journal, '') <> '' AND coalesce(cr_journal, '') <> '' AND lower(trim(coalesce(venue, ''))) NOT IN ('', 'unknown', 'none') AND NOT contains(lower(concat_ws(' ', oa_journal, cr_journal, venue)), 'ebook') AS given FROM t),
b AS (SELECT *, {_tsim('ct', 'co')} AS so, {_tsim('ct', 'cc')} AS sc, {_tsim('co', 'cc')} AS sb,
      CASE WHEN coalesce(NOT ab, false) OR (has AND (coalesce(NOT ao, false) OR coalesce(NOT ac, false))) THEN false WHEN has AND (coalesce(ab, false) OR coalesce(ao, false) OR coalesce(ac, false)) THEN true END AS am,
      CASE WHEN given THEN (CASE WHEN jo = '' OR jc = '' THEN 0.0 WHEN contains(jo, jc) OR contains(jc, jo) THEN 1.0 ELSE {_tsim('jo', 'jc')} END) >= 0.55 END AS jm FROM a),
c AS (SELECT *, greatest(so, sc) AS sim, oa = 'VERIFIED' AND cr = 'VERIFIED' AS twice, coalesce(am, true) AND coalesce(jm, true) AS calm FROM b),
d AS (SELECT *, sim >= 0.80 AND coalesce(am, false) AND twice AS strong FROM c),
e AS (SELECT *, NOT coalesce(am, true) OR (NOT coalesce(jm, true) AND NOT strong) OR ((oa = 'VERIFIED' OR cr = 'VERIFIED') AND sim < 0.70) AS conflict,
      twice AND sb >= 0.85 AND sim >= 0.80 AND coalesce(am, false) AND coalesce(jm, false) AS high, twice AND sim >= 0.70 AND sb >= 0.60 AND coalesce(am, true) AND (coalesce(jm, true) OR strong) AS mid,
      oa = 'VERIFIED' AND cr IN ('TIMEOUT', 'UNAVAILABLE', 'RATE_LIMITED') AS only_oa, cr = 'VERIFIED' AND oa IN ('TIMEOUT', 'UNAVAILABLE', 'RATE_LIMITED') AS only_cr,
      (oa = 'VERIFIED' AND cr = 'NOT_FOUND') OR (cr = 'VERIFIED' AND oa = 'NOT_FOUND') AS split FROM d),
f AS (SELECT *, CASE WHEN high THEN 'HIGH' WHEN mid OR (only_oa AND so >= 0.70 AND calm) OR (only_cr AND sc >= 0.70 AND calm) OR (split AND sim >= 0.70 AND calm) THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
      CASE WHEN high THEN 'HIGH' WHEN mid THEN 'MODERATE' WHEN twice THEN 'MISMATCH' WHEN only_oa THEN 'SINGLE_SOURCE (Crossref unavailable)' WHEN only_cr THEN 'SINGLE_SOURCE (OpenAlex unavailable)'
      WHEN split THEN 'SINGLE_SOURCE (Registry discrepancy)' WHEN oa = 'NOT_FOUND' AND cr = 'NOT_FOUND' THEN 'NOT_FOUND' ELSE 'UNAVAILABLE' END AS agreement FROM e)"""
SQL["r_decisions"] = f"""{_DECIDED}
SELECT f.rec_id, oa AS oa_status, cr AS cr_status, round(sim, 3) AS title_similarity, am AS authors_match, jm AS journal_match, confidence, agreement,
CASE WHEN coalesce(l.is_retracted, false) THEN 'RETRACTED' WHEN conflict THEN 'IDENTITY_MISMATCH' WHEN confidence = 'HIGH' AND agreement = 'HIGH' THEN 'VERIFIED' WHEN confidence = 'MEDIUM' THEN 'PROVISIONAL' ELSE 'UNVERIFIED' END AS identity_status
FROM f LEFT JOIN {_LATEST} l ON f.rec_id = l.rec_id
"""
SQL["r_identity"] = """
SELECT profile_id, CASE WHEN coalesce(is_retracted, false) THEN 'RETRACTED' WHEN coalesce(metadata_agreement = 'CONFLICT', false) THEN 'IDENTITY_MISMATCH' WHEN confidence_level = 'HIGH' AND metadata_agreement IN ('FULL', 'HIGH') THEN 'VERIFIED'
WHEN confidence_level = 'MEDIUM' THEN 'PROVISIONAL' ELSE 'UNVERIFIED' END AS identity_status FROM profiles
"""

_DOCS = "(SELECT * FROM documents WHERE doc_kind IN ('report', 'analysis', 'table') AND text IS NOT NULL)"


def _marks(x: str) -> str:
    return f"list_transform(flatten(list_transform(regexp_extract_all({x}, '\\[([0-9]+(?:\\s*,\\s*[0-9]+)*)\\]', 1), lambda g: regexp_split_to_array(g, '\\s*,\\s*'))), lambda v: CAST(v AS BIGINT))"


_AUDIT = f"""
l AS (SELECT doc_id, n, {_strip('ls[n]')} AS s FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r]') AS ls FROM {_DOCS}), unnest(range(1, len(ls) + 1)) t(n)),
m AS (SELECT *, starts_with(s, '```') AS fence, sum(CAST(starts_with(s, '```') AS INT)) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1 AS code,
      contains(s, '### Claim Verification Results') OR contains(s, '## Literature Summary Table') AS opens FROM l),
k AS (SELECT *, coalesce(last_value(CASE WHEN code OR fence THEN NULL WHEN opens THEN 1 WHEN starts_with(s, '## ') THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n), 0) = 1 AS inside FROM m),
u AS (SELECT doc_id, unnest(string_split(regexp_replace(s, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS t FROM k
      WHERE NOT (fence OR code OR inside OR opens OR s = '' OR regexp_matches(s, '^(#|\\||---|===)') OR starts_with(s, '- ❌') OR starts_with(s, '- ⚠️') OR starts_with(s, '- ℹ️'))),
q AS (SELECT doc_id, {_strip('t')} AS t FROM u),
per AS (SELECT doc_id, count(*) AS eligible, count(*) FILTER (len(list_filter({_marks('t')}, lambda v: v BETWEEN 1 AND 9)) > 0) AS cited FROM q
        WHERE length(t) >= 25 AND len(regexp_split_to_array(t, '\\s+')) >= 5 AND NOT regexp_matches(t, '^[#|]') GROUP BY doc_id),
tot AS (SELECT doc_id, text, len({_marks('text')}) AS total_markers, len(list_filter({_marks('text')}, lambda v: v BETWEEN 1 AND 9)) AS valid_markers FROM {_DOCS}),
aud AS (SELECT tot.*, coalesce(eligible, 0) AS eligible, coalesce(cited, 0) AS cited FROM tot LEFT JOIN per ON tot.doc_id = per.doc_id)"""
SQL["x_audit"] = f"WITH {_AUDIT} SELECT doc_id, total_markers, valid_markers, total_markers - valid_markers AS invalid_markers, eligible, cited, round(cited / nullif(eligible, 0) * 100, 2) AS coverage_percent FROM aud"


def _body(x: str) -> str:
    for mark in lx.BODY_ENDS:
        x = f"split_part({x}, {_lit(mark)}, 1)"
    return x


SQL["x_inline_counts"] = f"SELECT doc_id, len(regexp_extract_all({_body('text')}, '\\[[0-9]+\\]')) AS markers, length({_body('text')}) AS body_length FROM {_DOCS}"
_WC = lambda x: f"CASE WHEN {_strip(x)} = '' THEN 0 ELSE len(regexp_split_to_array({_strip(x)}, '\\s+')) END"
_RULE = "(sections * 0.35 + coverage * 0.25 + diversity * 0.15 + least(density / 10, 1.0) * 0.15 + CASE WHEN gap THEN 0.10 ELSE 0.0 END) * 10"
SQL["x_scores"] = f"""
WITH {_AUDIT},
z AS (SELECT doc_id, round(({' + '.join(f"CAST(contains(lower(text), {_lit(s)}) AS INT)" for s in lx.SECTIONS)}) / {len(lx.SECTIONS)}, 6) AS sections, round(CASE WHEN eligible > 0 THEN cited / eligible ELSE 0.0 END, 6) AS coverage,
      CASE WHEN {_WC('text')} > 0 THEN round(cited / ({_WC('text')}) * 1000, 2) ELSE 0.0 END AS density,
      CASE WHEN doc_id % 13 + doc_id % 9 > 0 THEN round((doc_id % 9) / (doc_id % 13 + doc_id % 9), 2) ELSE 0.0 END AS diversity,
      instr(lower(text), 'knowledge gap') > 0 AND {_WC("substr(text, greatest(instr(lower(text), 'knowledge gap'), 1), 600)")} > 40 AS gap FROM aud)
SELECT *, round(round({_RULE}, 6) * 100) / 100 AS rule_score, round(round(CASE WHEN doc_id % 2 = 0 THEN ({_RULE}) * 0.4 + (doc_id % 10 + 1) * 0.6 ELSE {_RULE} END, 6) * 100) / 100 AS overall FROM z
"""
SQL["x_ablation"] = """
SELECT upper(label) AS topic, round(avg(coalesce(confidence, 0)) FILTER (verdict_id % 2 <> 0), 4) AS verification_off, round(avg(coalesce(confidence, 0)) FILTER (verdict_id % 2 = 0), 4) AS verification_on FROM verdicts GROUP BY upper(label)
"""
SQL["v_interpreted"] = """
WITH a AS (SELECT verdict_id, upper(label) AS l, confidence AS c FROM verdicts WHERE confidence IS NOT NULL),
b AS (SELECT verdict_id, CASE WHEN c < 1 - c THEN 'NEUTRAL' WHEN l NOT IN ('ENTAILMENT', 'NEUTRAL', 'CONTRADICTION') THEN 'NEUTRAL' ELSE l END AS l, greatest(c, 1 - c) AS s FROM a)
SELECT verdict_id, CASE WHEN l <> 'NEUTRAL' AND s < 0.70 THEN 'NEUTRAL' ELSE l END AS label, round(s, 6) AS score FROM b
"""
_NEG = lambda x: f"list_has_any(regexp_split_to_array(lower({x}), '[^a-z]+'), {_list(('not', 'no', 'never', 'neither', 'without', 'nor', 'cannot', 'failed', 'fails'))})"
SQL["v_rule_labels"] = f"""
WITH a AS (SELECT item_id, claim, evidence, trim(coalesce(claim, '')) = '' OR trim(coalesce(evidence, '')) = '' AS blank, {_keywords('claim')} AS k, {_keywords('evidence')} AS e FROM evidence_items),
b AS (SELECT *, round(len(list_intersect(k, e)) / greatest(len(k), 1), 3) AS s FROM a)
SELECT item_id, CASE WHEN blank THEN 'UNVERIFIED' WHEN s < 0.70 THEN 'NEUTRAL' WHEN {_NEG('claim')} <> {_NEG('evidence')} THEN 'CONTRADICTION' ELSE 'ENTAILMENT' END AS label, CASE WHEN NOT blank THEN s END AS score FROM b
"""
SQL["m_cached_profiles"] = f"SELECT profile_id, coalesce((epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(checked_at)) / 3.6e9 <= 4032, false) AS hit FROM profiles"
_STRONG = "coalesce(title_similarity >= 0.80 AND coalesce(authors_match, false) AND openalex_status = 'VERIFIED' AND crossref_status = 'VERIFIED', false)"
SQL["m_reviewed_profiles"] = f"""
SELECT profile_id, CASE WHEN {_STRONG} AND metadata_agreement = 'CONFLICT' THEN 'MODERATE' ELSE metadata_agreement END AS metadata_agreement,
CASE WHEN {_STRONG} AND confidence_level = 'LOW' THEN 'MEDIUM' ELSE confidence_level END AS confidence_level FROM profiles
"""

_CLAIMS = f"""{_RUNS},
cl AS (SELECT run_id, item_id AS claim_id, claim FROM ev WHERE claim <> '' QUALIFY row_number() OVER (PARTITION BY run_id, claim ORDER BY item_id) = 1)"""


def _pairs(where: str) -> str:
    return f"""
ck AS (SELECT run_id, claim_id, least(2, len(k)) AS need, unnest(k) AS w FROM (SELECT run_id, claim_id, {_keywords('claim')} AS k FROM cl)),
sk AS (SELECT run_id, rec_id AS source_id, unnest({_keywords("coalesce(title, '') || '. ' || coalesce(content, '')")}) AS w FROM rsrc {where}),
pr AS (SELECT claim_id, source_id FROM ck JOIN sk ON ck.run_id = sk.run_id AND ck.w = sk.w GROUP BY claim_id, source_id, need HAVING count(*) >= need)"""


SQL["c_prefilter"] = f"WITH {_CLAIMS}, {_pairs('')} SELECT claim_id, source_id FROM pr"
_QT = _terms("claim", 2, "a-z0-9")
_QK = f"list_filter({_QT}, lambda w: NOT list_contains({_list(lx.CLAIM_STOP_WORDS)}, w))"
_ALL_WINDOWS = _WINDOWS.replace("FROM academic_sources", "FROM (SELECT rec_id, content FROM academic_sources UNION ALL SELECT rec_id, content FROM pinned_sources)")
_BEST = f"""
tm AS (SELECT rec_id AS source_id, n AS win, {_terms('passage', 2, 'a-z0-9')} AS t FROM win),
st AS (SELECT source_id, count(*) AS n, avg(len(t)) AS avgdl FROM tm GROUP BY source_id),
tf AS (SELECT source_id, win, dl, w, count(*) AS tf FROM (SELECT source_id, win, len(t) AS dl, unnest(t) AS w FROM tm) GROUP BY ALL),
df AS (SELECT source_id, w, count(*) AS df FROM tf GROUP BY ALL),
qq AS (SELECT claim_id, w, count(*) AS times FROM (SELECT claim_id, unnest(CASE WHEN len({_QK}) > 0 THEN {_QK} ELSE {_QT} END) AS w FROM cl) GROUP BY ALL),
sc AS (SELECT pr.claim_id, pr.source_id, tf.win, round(sum(qq.times * ln((st.n - df.df + 0.5) / (df.df + 0.5) + 1) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * tf.dl / st.avgdl))), 6) AS score
       FROM pr JOIN qq ON pr.claim_id = qq.claim_id JOIN tf ON tf.source_id = pr.source_id AND tf.w = qq.w JOIN df ON df.source_id = tf.source_id AND df.w = tf.w JOIN st ON st.source_id = pr.source_id GROUP BY ALL),
be AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY claim_id, source_id ORDER BY score DESC, win) = 1),
bp AS (SELECT be.claim_id, be.source_id, be.win, CASE WHEN length(passage) > 500 THEN substr(passage, 1, 500) || '...' ELSE passage END AS passage, score FROM be JOIN win ON win.rec_id = be.source_id AND win.n = be.win WHERE score > 0)"""
SQL["c_best_passages"] = f"""
WITH {_CLAIMS}, {_pairs("WHERE content <> ''")}, {_ALL_WINDOWS}, {_BEST}
SELECT claim_id, source_id, win AS "window", passage, score FROM bp
"""
# a pass in order that keeps what is like no kept one: one step a row, over all scopes at once
def _greedy(rows: str, least: float) -> str:
    """``g`` with the ids that stay, from ``rows`` (scope, id, o, t)."""
    return f"""
q AS (SELECT scope, id, t, row_number() OVER (PARTITION BY scope ORDER BY o) AS rn FROM ({rows})),
g AS (
  SELECT DISTINCT scope, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[][]) AS kept, CAST(NULL AS BIGINT) AS id FROM q
  UNION ALL
  SELECT g.scope, q.rn, CASE WHEN like_kept THEN g.kept ELSE list_append(g.kept, q.t) END, CASE WHEN like_kept THEN NULL ELSE q.id END
  FROM (SELECT g.scope, g.rn, g.kept, q.rn AS next, q.id, q.t, len(q.t) > 0 AND len(list_filter(g.kept, lambda k: {_jaccard('k', 'q.t')} >= {least} - 1e-9)) > 0 AS like_kept FROM g JOIN q ON q.scope = g.scope AND q.rn = g.rn + 1) g
  JOIN q ON q.scope = g.scope AND q.rn = g.next
)"""


_D0 = f"SELECT * FROM academic_sources WHERE {_strip('coalesce(title, ' + chr(39) * 2 + ')')} <> '' AND lower({_strip('title')}) NOT IN ('untitled', 'unknown title', 'none', 'no title')"
SQL["d_academic"] = f"""
WITH RECURSIVE s1 AS (SELECT * FROM (SELECT *, {_dedup_doi('doi')} AS k FROM ({_D0})) QUALIFY k = '' OR row_number() OVER (PARTITION BY run_id, k ORDER BY pos) = 1),
s2 AS (SELECT * FROM (SELECT *, lower({_strip('coalesce(url, ' + chr(39) * 2 + ')')}) AS u FROM s1) QUALIFY u = '' OR row_number() OVER (PARTITION BY run_id, u ORDER BY pos) = 1),
{_greedy(f"SELECT run_id AS scope, rec_id AS id, pos AS o, list_distinct(list_filter(string_split({_title_form('title')}, ' '), lambda w: w <> '')) AS t FROM s2", 0.85)}
SELECT scope AS run_id, id AS rec_id FROM g WHERE id IS NOT NULL
"""
_CORE = f"""{_RUNS},
entailed AS (SELECT ev.* FROM ev JOIN {_LAST_LABELS} l ON ev.item_id = l.item_id WHERE l.last_label = 'ENTAILMENT' AND {_strip('coalesce(ev.claim, ' + chr(39) * 2 + ')')} <> '' AND NOT regexp_matches(ev.claim, '(?i){lx.COMMERCE}')),
{_greedy(f"SELECT run_id AS scope, item_id AS id, item_id AS o, {_words('claim')} AS t FROM entailed", 0.70)},
core AS (SELECT e.* FROM entailed e JOIN g ON g.id = e.item_id QUALIFY row_number() OVER (PARTITION BY e.run_id ORDER BY e.item_id) <= 5)"""
SQL["c_core_claims"] = f"WITH RECURSIVE {_CORE} SELECT run_id, item_id, claim FROM core"
_PROFILED = f"""{_CORE},
prof AS {_LATEST},
ss AS (SELECT r.*, p.is_retracted, {_canonical('r.doi', 'r.url', 'r.title')} AS cid, {_source_key('r.doi', 'r.url', 'r.title')} AS skey FROM rsrc r LEFT JOIN (SELECT rec_id, is_retracted FROM prof WHERE rec_id NOT IN (SELECT rec_id FROM pin)) p ON r.rec_id = p.rec_id),
gone AS (SELECT DISTINCT run_id, cid FROM ss WHERE is_retracted),
cl AS (
  SELECT c.run_id, c.item_id AS claim_id, c.claim, c.evidence, c.own_cid, c.own_skey, coalesce(c.is_retracted, false) OR gone.cid IS NOT NULL AS is_retracted
  FROM (SELECT *, {_canonical('sdoi', 'surl', 'stitle')} AS own_cid, {_source_key('sdoi', 'surl', 'stitle')} AS own_skey FROM core) c LEFT JOIN gone ON gone.run_id = c.run_id AND gone.cid = c.own_cid),
fp AS (SELECT cl.claim_id, ss.rec_id AS source_id, ss.cid, ss.skey, row_number() OVER (PARTITION BY cl.claim_id ORDER BY ss.pos, ss.rec_id) AS rn FROM cl JOIN ss ON ss.run_id = cl.run_id
       WHERE NOT (coalesce(ss.cid = cl.own_cid, false) OR (cl.own_skey <> '' AND coalesce(ss.skey = cl.own_skey, false)))),
fr AS (
  SELECT DISTINCT claim_id, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS BIGINT) AS source_id FROM fp
  UNION ALL
  SELECT x.claim_id, x.rn, CASE WHEN x.twice THEN x.seen ELSE list_concat(x.seen, x.keys) END, CASE WHEN x.twice THEN NULL ELSE x.source_id END
  FROM (SELECT y.*, len(list_intersect(y.seen, y.keys)) > 0 AS twice FROM (SELECT fr.claim_id, fp.rn, fr.seen, fp.source_id, list_filter(['c' || nullif(fp.cid, ''), 's' || nullif(fp.skey, '')], lambda k: k IS NOT NULL) AS keys FROM fr JOIN fp ON fp.claim_id = fr.claim_id AND fp.rn = fr.rn + 1) y) x
),
{_pairs("WHERE " + _strip("coalesce(content, '')") + " <> ''").replace("pr AS (", "pr0 AS (")},
pr AS (SELECT pr0.claim_id, pr0.source_id FROM pr0 JOIN fr ON fr.claim_id = pr0.claim_id AND fr.source_id = pr0.source_id),
{_ALL_WINDOWS}, {_BEST},
lb AS (SELECT bp.claim_id, bp.source_id, cl.claim, bp.passage AS evidence, {_keywords('cl.claim')} AS k, {_keywords('bp.passage')} AS e FROM bp JOIN cl ON cl.claim_id = bp.claim_id),
la AS (SELECT claim_id, source_id, CASE WHEN trim(evidence) = '' THEN 'UNVERIFIED' WHEN round(len(list_intersect(k, e)) / greatest(len(k), 1), 3) < 0.70 THEN 'NEUTRAL' WHEN {_NEG('claim')} <> {_NEG('evidence')} THEN 'CONTRADICTION' ELSE 'ENTAILMENT' END AS label FROM lb),
rt AS (SELECT rec_id AS source_id, coalesce(bool_or(is_retracted), false) AS gone FROM ss GROUP BY rec_id),
ct AS (SELECT la.claim_id, count(*) FILTER (label = 'ENTAILMENT' AND NOT gone) AS ind, count(*) FILTER (label = 'CONTRADICTION' AND NOT gone) AS con, count(*) FILTER (gone) AS ret FROM la JOIN rt USING (source_id) GROUP BY la.claim_id),
co AS (SELECT cl.run_id, cl.claim_id, cl.claim, coalesce(ind, 0) AS independent, coalesce(con, 0) AS contradicting, CAST({_strip("coalesce(evidence, '')")} <> '' AND NOT is_retracted AS BIGINT) AS origin,
       coalesce(ret, 0) + CAST({_strip("coalesce(evidence, '')")} <> '' AND is_retracted AS BIGINT) AS alerts FROM cl LEFT JOIN ct USING (claim_id)),
cv AS (SELECT *, origin + independent AS supporting,
       CASE WHEN independent >= 1 AND contradicting = 0 AND origin + independent >= 2 THEN 'CONSISTENT_SUPPORT' WHEN origin + independent >= 1 AND contradicting >= 1 THEN 'MIXED_EVIDENCE'
       WHEN contradicting >= 1 AND origin + independent = 0 THEN 'PREDOMINANTLY_CONTRADICTED' WHEN origin + independent = 1 AND contradicting = 0 THEN 'SINGLE_SOURCE_CLAIM' ELSE 'UNADDRESSED' END AS verdict FROM co)"""
SQL["c_consensus"] = f"""
WITH RECURSIVE {_PROFILED}
SELECT run_id, claim_id, claim, supporting, independent, contradicting, alerts, verdict,
CASE WHEN verdict = 'CONSISTENT_SUPPORT' AND origin >= 1 THEN 'Supported by originating paper and corroborated by ' || independent || ' independent academic source(s) with zero contradictory findings.'
WHEN verdict = 'CONSISTENT_SUPPORT' THEN 'Supported by ' || independent || ' independent academic source(s) with zero contradictory findings.'
WHEN verdict = 'MIXED_EVIDENCE' THEN 'Conflicting findings observed across literature: ' || supporting || ' supporting (' || independent || ' independent) vs ' || contradicting || ' contradicting source(s).'
WHEN verdict = 'PREDOMINANTLY_CONTRADICTED' THEN 'Literature contradicts this claim (' || contradicting || ' contradictory finding(s), ' || contradicting || ' independent).'
WHEN verdict = 'SINGLE_SOURCE_CLAIM' AND origin >= 1 THEN 'Supported by originating paper, but not corroborated or tested across other retrieved sources.'
WHEN verdict = 'SINGLE_SOURCE_CLAIM' THEN 'Supported by a single literature source, without independent corroboration.' ELSE 'No authoritative evidence found across the retrieved literature.' END AS reason FROM cv
"""
SQL["c_histogram"] = f"WITH RECURSIVE {_PROFILED} SELECT verdict, count(*) AS claims FROM cv GROUP BY verdict"
SQL["c_table_rows"] = f"""
WITH RECURSIVE {_PROFILED}
SELECT run_id, claim_id, '| [' || row_number() OVER (PARTITION BY run_id ORDER BY claim_id) || '] | ' || CASE WHEN length(claim) > 60 THEN substr(claim, 1, 60) || '...' ELSE claim END || ' | ' || supporting || ' | ' || contradicting || ' | ' || alerts || ' | ' || verdict || ' |' AS row FROM cv
"""
SQL["c_nearest"] = """
WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 6) AS similarity FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, similarity FROM s WHERE similarity >= 0.40 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) = 1
"""


def _badge(c: str, names: dict, other: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in names.items()) + f" ELSE {_lit(other)} END"


def _short(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END"


_T = "coalesce(nullif(title, ''), 'Untitled')"
_V0 = "trim(coalesce(nullif(journal_name, ''), nullif(publisher, ''), 'Academic Record'))"
_V = f"CASE WHEN lower({_V0}) IN ('unknown', '', 'none') THEN coalesce(nullif(publisher, ''), 'Academic Record') ELSE {_V0} END"
SQL["z_quality_rows"] = f"""
SELECT profile_id, '| [' || (profile_id % 100) || '] | ' || {_short(_T, 42)} || ' | ' || {_badge('openalex_status', render.REGISTRY, '⚠️ Unavailable')} || ' | ' || {_badge('crossref_status', render.REGISTRY, '⚠️ Unavailable')} || ' | ' ||
CASE WHEN coalesce(is_retracted, false) THEN '🔴 **RETRACTED**' ELSE '🟢 No retraction flag (OpenAlex/Crossref)' END || ' | ' || {_short('(' + _V + ')', 45)} || ' | `' || coalesce(nullif(issn, ''), 'N/A') || '` | ' ||
CASE WHEN coalesce(title_similarity, 0) >= 0.75 THEN '✅ Match (' ELSE '⚠️ Review (' END || printf('%.2f', round(coalesce(title_similarity, 0.0), 2)) || ') | ' || translate(coalesce(metadata_agreement, 'N/A'), '|' || chr(10), '/ ') || ' | ' ||
{_badge('identity_status', render.IDENTITY, '⚪ UNVERIFIED')} || ' | ' || {_badge('confidence_level', render.CONFIDENCE, '⚪ LOW')} || ' |' AS row FROM profiles
"""
SQL["z_source_lists"] = """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS n FROM academic_sources QUALIFY n <= 12)
SELECT run_id, string_agg('[' || n || '] [' || coalesce(title, 'Untitled') || '](' || coalesce(url, '') || ')' || chr(10) || '    ' || concat_ws(' | ', '**Harvested From:** ' || coalesce(nullif(source, ''), 'Web Search'), '**Venue:** *' || nullif(venue, '') || '*'), chr(10) ORDER BY n) AS text FROM a GROUP BY run_id
"""
SQL["z_audit_texts"] = f"""
WITH {_AUDIT} SELECT doc_id, '## Citation Integrity Audit' || chr(10) || chr(10) || '- Eligible factual-claim candidates: ' || eligible || chr(10) || '- Candidates with at least one registered citation: ' || cited || chr(10) ||
'- Claim-level citation coverage: ' || CASE WHEN eligible = 0 THEN 'None' ELSE printf('%.2f', round(cited / eligible * 100, 2)) END || '%' || chr(10) || '- Invalid citation marker occurrences: ' || (total_markers - valid_markers) || chr(10) || '- Total inline citation marker occurrences: ' || total_markers AS text FROM aud
"""
_FORM = lambda x: f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
SQL["q_in_source"] = f"""
WITH s AS (SELECT rec_id, title, content FROM academic_sources UNION ALL SELECT rec_id, title, content FROM pinned_sources),
x AS (SELECT e.item_id, {_FORM("coalesce(e.evidence, '')")} AS e, {_FORM("coalesce(s.title, '') || ' ' || coalesce(s.content, '')")} AS f FROM evidence_items e JOIN s ON e.source_id = 'source_' || s.rec_id),
y AS (SELECT *, CAST(ceil(length(e) * 0.7 - 1e-9) AS BIGINT) AS need FROM x)
SELECT item_id, e <> '' AND f <> '' AND len(list_filter(range(1, greatest(length(e) - need + 1, 1) + 1), lambda i: contains(f, substr(e, i, need)))) > 0 AS found FROM y
"""
