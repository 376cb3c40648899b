"""Queries over what is harvested, verified and scored beyond the core queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators import citations, harvest, registry, scorecard
from attesta.operators.ordered import like_any
from attesta.plans import core, render
from attesta.plans import sql as q
from attesta.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


@query
def h_merged_search(s, d):
    """The search results of each run from all providers as one list."""
    retracted = core._latest_profiles(s, d).select("rec_id", "is_retracted")
    x = table(s, d, "academic_sources").join(retracted, "rec_id", "left")
    return harvest.merged_search(x, F.col("is_retracted")).select("run_id", "rec_id")


_PRIO = "CASE source WHEN 'Semantic Scholar' THEN 0 WHEN 'OpenAlex' THEN 1 WHEN 'Crossref' THEN 2 ELSE 3 END"
_TAGLESS = f"CASE WHEN source = 'Crossref' THEN trim(regexp_replace(regexp_replace(coalesce(content, ''), '<[^>]+>', ' ', 'g'), '{q._SP}+', ' ', 'g')) ELSE content END"
SQL["h_merged_search"] = f"""
WITH RECURSIVE x AS (SELECT a.* FROM (SELECT * REPLACE ({_TAGLESS} AS content), CAST({_PRIO} AS BIGINT) * 1000000000 + pos AS place FROM ({q._D0})) a LEFT JOIN {q._LATEST} p ON a.rec_id = p.rec_id WHERE NOT (a.source = 'OpenAlex' AND coalesce(p.is_retracted, false))),
s1 AS (SELECT * FROM (SELECT *, {q._dedup_doi('doi')} AS k FROM x) QUALIFY k = '' OR row_number() OVER (PARTITION BY run_id, k ORDER BY place) = 1),
s2 AS (SELECT * FROM (SELECT *, lower({q._strip('coalesce(url, ' + chr(39) * 2 + ')')}) AS u FROM s1) QUALIFY u = '' OR row_number() OVER (PARTITION BY run_id, u ORDER BY place) = 1),
{q._greedy(f"SELECT run_id AS scope, rec_id AS id, place AS o, list_distinct(list_filter(string_split({q._title_form('title')}, ' '), lambda w: w <> '')) AS t FROM s2", 0.85)}
SELECT s2.run_id, s2.rec_id FROM s2 JOIN g ON g.id = s2.rec_id QUALIFY coalesce(content, '') <> '' OR NOT bool_or(coalesce(content, '') <> '') OVER (PARTITION BY s2.run_id)
"""


@query
def h_not_retracted(s, d):
    p = core._latest_profiles(s, d).where("is_retracted").select("rec_id")
    return table(s, d, "academic_sources").join(p, "rec_id", "left_anti").select("rec_id")


SQL["h_not_retracted"] = f"SELECT rec_id FROM academic_sources WHERE rec_id NOT IN (SELECT rec_id FROM {q._LATEST} WHERE is_retracted)"


@query
def h_strict_web(s, d):
    return harvest.web_results(table(s, d, "academic_sources").withColumn("url", core._web_url()), strict=True).select("run_id", "rec_id")


SQL["h_strict_web"] = f"SELECT run_id, rec_id FROM (SELECT run_id, rec_id, pos, {q._tier('u')} AS tier, {q._web_url('u')} AS c FROM {q._MADE}) WHERE tier = 1 QUALIFY row_number() OVER (PARTITION BY run_id, c ORDER BY pos) = 1"


@query
def h_merged_sources(s, d):
    """Sources of two rounds: places below five, then the others."""
    x = table(s, d, "academic_sources").withColumn("url", core._web_url())
    return harvest.merged_sources(x.where("pos < 5"), x.where("pos >= 5")).select("run_id", "rec_id")


SQL["h_merged_sources"] = f"SELECT run_id, rec_id FROM (SELECT run_id, rec_id, pos, {q._url('u', q._RESEARCH_AUTH, '^utm_[^=]*=')} AS c FROM {q._MADE}) WHERE c <> '' QUALIFY row_number() OVER (PARTITION BY run_id, c ORDER BY pos) = 1"


@query
def h_gap_hits(s, d):
    x = table(s, d, "academic_sources").withColumn("query", F.col("rec_id") % 2)
    return harvest.gap_hits(x).select("run_id", "rec_id")


SQL["h_gap_hits"] = f"SELECT run_id, rec_id FROM (SELECT *, lower({q._strip('coalesce(url, ' + chr(39) * 2 + ')')}) AS u FROM academic_sources) WHERE u <> '' QUALIFY row_number() OVER (PARTITION BY run_id, u ORDER BY rec_id % 2, pos) = 1"


@query
def h_first_answering(s, d):
    """The results of the first provider of each run that has any."""
    return harvest.first_answering(table(s, d, "academic_sources").withColumn("provider_rank", harvest.provider_rank(F.col("source")))).select("run_id", "rec_id")


SQL["h_first_answering"] = f"SELECT run_id, rec_id FROM academic_sources QUALIFY {_PRIO} = min({_PRIO}) OVER (PARTITION BY run_id)"


@query
def h_new_sources(s, d):
    """Sources from the place five on whose address and DOI are not among the first five of their run."""
    x = table(s, d, "academic_sources")
    return harvest.new_sources(x.where("pos >= 5"), x.where("pos < 5")).select("rec_id")


SQL["h_new_sources"] = f"""
WITH a AS (SELECT run_id, rec_id, pos, nullif(lower({q._strip('coalesce(url, ' + chr(39) * 2 + ')')}), '') AS u, nullif({q._literature_doi('doi')}, '') AS k FROM academic_sources)
SELECT rec_id FROM a WHERE pos >= 5 AND NOT EXISTS (SELECT 1 FROM a b WHERE b.pos < 5 AND b.run_id = a.run_id AND (b.u = a.u OR b.k = a.k))
"""


@query
def h_unsupported(s, d):
    """Verdicts that a model gave and that do not support their claim."""
    return table(s, d, "verdicts").where(F.upper("label").isin("NEUTRAL", "CONTRADICTION")).select("verdict_id")


SQL["h_unsupported"] = "SELECT verdict_id FROM verdicts WHERE upper(label) IN ('NEUTRAL', 'CONTRADICTION')"


@query
def h_badges(s, d):
    """Index badges of a profile and of its Crossref record, each once, in the order they were seen."""
    return table(s, d, "profiles").select("profile_id", F.array_join(F.array_union(F.coalesce("indexed_in", F.array().cast("array<string>")), F.array(F.lit("CrossRef (Official DOI Registrar)"), F.lit("DOAJ"))), "; ").alias("badges"))


SQL["h_badges"] = """
WITH a AS (SELECT profile_id, list_concat(coalesce(indexed_in, []), ['CrossRef (Official DOI Registrar)', 'DOAJ']) AS l FROM profiles)
SELECT profile_id, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), '; ') AS badges FROM a
"""


@query
def h_verified(s, d):
    """Every paper with the cases that are settled before registries are compared."""
    x = core._decided(s, d, False, registry.with_exits)
    return x.select("rec_id", "oa_status", "cr_status", "confidence", "agreement", "identity_status")


_PRE = "(contains(lower(coalesce(f.url, '')), 'arxiv.org') OR contains(lower(coalesce(f.doi, '')), 'arxiv') OR contains(lower(coalesce(f.venue, '')), 'arxiv'))"
_NO = "trim(coalesce(f.doi, '')) = ''"
SQL["h_verified"] = q._DECIDED + f"""
, vv AS (SELECT f.*, {_PRE} AS pre, {_NO} AS nodoi, coalesce(l.is_retracted, false) AS gone FROM f LEFT JOIN {q._LATEST} l ON f.rec_id = l.rec_id),
vw AS (SELECT *, CASE WHEN pre THEN 'MEDIUM' WHEN nodoi THEN 'LOW' WHEN gone THEN 'RETRACTED_WARNING' ELSE confidence END AS conf, CASE WHEN pre THEN 'N/A (Preprint)' WHEN nodoi OR gone THEN '' ELSE agreement END AS agr FROM vv)
SELECT rec_id, CASE WHEN pre THEN 'SKIPPED (Preprint)' WHEN nodoi THEN 'SKIPPED' ELSE oa END AS oa_status, CASE WHEN pre THEN 'SKIPPED (Preprint)' WHEN nodoi THEN 'SKIPPED' ELSE cr END AS cr_status, conf AS confidence, agr AS agreement,
CASE WHEN gone AND NOT pre AND NOT nodoi THEN 'RETRACTED' WHEN conflict AND NOT pre AND NOT nodoi THEN 'IDENTITY_MISMATCH' WHEN conf = 'HIGH' AND agr = 'HIGH' THEN 'VERIFIED' WHEN conf = 'MEDIUM' THEN 'PROVISIONAL' ELSE 'UNVERIFIED' END AS identity_status FROM vw
"""


@query
def h_coverage(s, d):
    """Coverage by the audit section where a report has one (every fourth gets one here), else by its sentences."""
    r = core._reports(s, d).withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("\n- Eligible factual-claim candidates: "), (F.col("doc_id") % 12).cast("string"), F.lit("\n- Candidates with at least one registered citation: "), (F.col("doc_id") % 5).cast("string"))).otherwise(F.col("text")))
    a = citations.audit(r, F.lit(9)).select("doc_id", "eligible", "cited")
    return r.join(a, "doc_id").select("doc_id", F.round(scorecard.coverage(F.col("text"), F.col("cited"), F.col("eligible")), 6).alias("coverage"))


SQL["h_coverage"] = f"""
WITH {q._AUDIT}
SELECT doc_id, round(CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 12 > 0 THEN (doc_id % 5) / (doc_id % 12) ELSE 0.0 END WHEN regexp_extract(text, 'Eligible factual-claim candidates:\\s*([0-9]+)', 1) <> '' AND regexp_extract(text, 'Candidates with at least one registered citation:\\s*([0-9]+)', 1) <> ''
THEN coalesce(TRY_CAST(regexp_extract(text, 'Candidates with at least one registered citation:\\s*([0-9]+)', 1) AS DOUBLE) / nullif(TRY_CAST(regexp_extract(text, 'Eligible factual-claim candidates:\\s*([0-9]+)', 1) AS DOUBLE), 0), 0.0) WHEN eligible > 0 THEN cited / eligible ELSE 0.0 END, 6) AS coverage FROM aud
"""


@query
def h_judged(s, d):
    names = [((F.col("doc_id") * (i + 3)) % 12).cast("int").alias(n) for i, n in enumerate(scorecard.JUDGED)]
    return core._reports(s, d).select("doc_id", scorecard.judge_average(F.struct(*names)).alias("judge"))


_J = [f"(doc_id * {i + 3}) % 12" for i in range(5)]
SQL["h_judged"] = f"SELECT doc_id, CASE WHEN {' AND '.join(f'{x} BETWEEN 1 AND 10' for x in _J)} THEN round(({' + '.join(_J)}) / 5, 2) END AS judge FROM {q._DOCS}"


@query
def h_eval_summaries(s, d):
    x = core.x_scores(s, d)
    return x.select("doc_id", render.eval_summary(F.col("overall"), F.col("sections"), F.col("coverage"), F.col("density"), F.col("gap")).alias("text"))


SQL["h_eval_summaries"] = q.SQL["x_scores"].replace("SELECT *, round(round(", ", y AS (SELECT *, round(round(", 1).rstrip() + """)
SELECT doc_id, 'Score ' || printf('%.2f', overall) || '/10 | sections ' || CAST(round(sections * 100) AS INT) || '% | citation coverage ' || CAST(round(coverage * 100) AS INT) || '% | evidence ' || printf('%.2f', density) || ' per 1k words | gap noted ' || CASE WHEN gap THEN 'YES' ELSE 'NO' END AS text FROM y
"""


@query
def h_spliced(s, d):
    """Reports with a block before their recommendations, or at the end if they have none."""
    r = core._reports(s, d)
    return r.select("doc_id", F.length(render.spliced(F.col("text"), F.lit("\n\n### Claims without support\n- x"))).cast("bigint").alias("chars"), render.gap_section(F.col("text")).alias("gaps"))


SQL["h_spliced"] = f"""
SELECT doc_id, length(text) + CASE WHEN contains(text, '## 6. Recommendations') THEN length(chr(10) || chr(10) || '### Claims without support' || chr(10) || '- x') + 2 - (length(text) - length(split_part(text, '## 6. Recommendations', 1) || '## 6. Recommendations' || split_part(text, '## 6. Recommendations', 2)))
ELSE length(chr(10) || chr(10) || '### Claims without support' || chr(10) || '- x') END AS chars,
{q._strip("regexp_extract(text || chr(10) || '## 6.', '(?s)##\\s*5\\.\\s*Knowledge Gaps\\s*(.*?)\\n##\\s*6\\.', 1)")} AS gaps FROM {q._DOCS}
"""


@query
def h_reports(s, d):
    part = lambda x: F.lit("\n\n" + x)
    x = core._reports(s, d)
    return x.select("doc_id", F.sha2(render.whole_report(F.col("text"), part("Literature"), F.lit(None).cast("string"), part("Quality"), part("Audit"), F.col("source")), 256).alias("digest"))


SQL["h_reports"] = f"SELECT doc_id, sha256(text || chr(10) || chr(10) || 'Literature' || chr(10) || chr(10) || 'Quality' || chr(10) || chr(10) || 'Audit' || chr(10) || chr(10) || '### Sources' || chr(10) || chr(10) || coalesce(source, '')) AS digest FROM {q._DOCS}"


@query
def h_recommendations(s, d):
    """A section with one proposal for each journal with an odd number, and the section that says there is none for the others."""
    item = F.struct(F.col("journal_name").alias("title"), F.lit("HIGH").alias("novelty"), F.lit("ADVANCED").alias("difficulty"), F.lit("g").alias("gap"), F.lit("a").alias("approach"))
    return table(s, d, "journals").select("journal_id", render.recommendations(F.lit("T"), F.lit("S"), F.filter(F.array(item), lambda _: F.col("journal_id") % 2 == 1)).alias("text"))


_NL = "chr(10)"
SQL["h_recommendations"] = f"""
SELECT journal_id, CASE WHEN journal_id % 2 = 1 THEN replace('~~---~~## Research Opportunities~~> *Under-explored directions in: **T***~~S~~### 1. ', '~', {_NL}) || journal_name ||
replace('~~**Novelty:** 🔴 HIGH &nbsp;|&nbsp; **Difficulty:** ⭐⭐⭐ ADVANCED~~**Why under-explored:** g~~**Suggested approach:** a~', '~', {_NL}) ELSE replace('~~---~~## Research Opportunities~~*No recommendations could be generated.*~', '~', {_NL}) END AS text FROM journals
"""


@query
def h_cascade(s, d):
    """The passage of each run's sources that speaks of its core claims, by words or else by meaning (offline vectors, without a model)."""
    from attesta.operators import consensus, retrieval

    claims = consensus.core_claims(core._run_evidence(s, d), table(s, d, "verdicts")).select("run_id", F.col("item_id").alias("claim_id"), "claim")
    sources = core._run_sources(s, d).where("content <> ''")
    pairs = claims.select("run_id", "claim_id").join(sources.select("run_id", "source_id"), "run_id")
    return retrieval.cascade(pairs, claims, sources, ["run_id"]).select("claim_id", "source_id", "passage", "score", "method")


@query
def h_valid_gaps(s, d):
    """Proposals, one an item of evidence: long enough, without scores in the text, and with a title like no source title of their run."""
    title = F.when(F.col("item_id") % 3 == 0, F.concat(F.coalesce("stitle", F.lit("")), F.lit(" revisited"))).otherwise(F.coalesce("claim", F.lit("")))
    count = lambda c: F.size(F.filter(F.split(tx.one_line(F.coalesce(c, F.lit(""))), " "), lambda w: w != ""))
    x = core._run_evidence(s, d).where((count("claim") >= 8) & (count("evidence") >= 8) & ~F.contains("claim", F.lit("Novelty =")) & ~F.contains("claim", F.lit("Difficulty =")))
    props = x.select("run_id", "item_id", F.array_sort(tx.words(title)).alias("t"))
    like = like_any(props, core._run_sources(s, d).where("title <> ''").select("run_id", tx.words(F.col("title")).alias("t")), ["run_id"], "t", 0.65)
    return props.join(like, ["run_id", "t"], "left_anti").select("item_id")


SQL["h_valid_gaps"] = f"""
WITH {q._RUNS},
p AS (SELECT run_id, item_id, {q._words("CASE WHEN item_id % 3 = 0 THEN coalesce(stitle, '') || ' revisited' ELSE coalesce(claim, '') END")} AS a FROM ev
      WHERE {q._COUNT('claim')} >= 8 AND {q._COUNT('evidence')} >= 8 AND NOT contains(claim, 'Novelty =') AND NOT contains(claim, 'Difficulty =')),
t AS (SELECT DISTINCT run_id, {q._words('title')} AS b FROM rsrc WHERE title <> '')
SELECT item_id FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.run_id = p.run_id AND {q._jaccard('p.a', 't.b')} > 0.65)
"""
