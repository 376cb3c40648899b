"""The queries of the core library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from attesta.functions import identity as idy
from attesta.functions import lexicon as lx
from attesta.functions import quotes, text as tx
from attesta.operators import citations, consensus, lookup, ordered, ranked, registry, retrieval, scorecard, trust, verdicts
from attesta.plans import render
from attesta.sources.cache import fresh
from attesta.sources.tables import table

NOW = "2025-11-01 00:00:00"
TOPIC = "Seagrass monitoring with drone fleets"
HOSTS = ("nature.com", "amazon.com", "mit.edu", "arxiv.org", "xhamster.com", "blog.net", "m.youtube.com", "nih.gov", "en.wikipedia.org", "user:pw@Plos.org:8080")

Q: dict = {}


def query(f):
    Q[f.__name__] = f
    return f


def _sources(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "academic_sources")


def _evidence(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "evidence_items")


def _web_url() -> Column:
    """Addresses on hosts of every kind, made from the row."""
    host = F.element_at(F.array(*map(F.lit, HOSTS)), (F.col("rec_id") % len(HOSTS) + 1).cast("int"))
    path = F.when(F.col("rec_id") % 20 == 8, "/wiki/Network").otherwise(F.concat(F.lit("/p/"), (F.col("rec_id") % 977).cast("string")))
    tail = F.when(F.col("rec_id") % 3 == 0, F.concat(F.lit("/?utm_source=x&page="), (F.col("rec_id") % 4).cast("string"), F.lit("&ref=a#top"))).when(F.col("rec_id") % 3 == 1, "/").otherwise("?q=&id=7")
    return F.concat(F.lit("HTTPS://"), host, path, tail)


# keys


@query
def k_source_keys(s, d):
    return _sources(s, d).select("rec_id", idy.source_key(F.col("doi"), F.col("url"), F.col("title")).alias("source_key"))


@query
def k_evidence_ids(s, d):
    return _evidence(s, d).select("item_id", idy.evidence_id(F.col("source_key"), F.col("evidence"), F.col("claim")).alias("made_id"))


@query
def k_canonical_ids(s, d):
    return _sources(s, d).select("rec_id", idy.canonical_id(F.col("doi"), F.col("url"), F.col("title")).alias("canonical_id"))


@query
def k_doi_forms(s, d):
    c = F.col("doi")
    return _sources(s, d).select("rec_id", idy.report_doi(c).alias("report_doi"), idy.literature_doi(c).alias("literature_doi"), idy.dedup_doi(c).alias("dedup_doi"))


@query
def k_urls(s, d):
    u = F.col("u")
    return _sources(s, d).select("rec_id", _web_url().alias("u")).select("rec_id", idy.web_url(u).alias("web_url"), idy.research_url(u).alias("research_url"), idy.report_url(u).alias("report_url"), idy.url_host(u).alias("host"))


@query
def k_aliases(s, d):
    return _sources(s, d).select("rec_id", F.posexplode(idy.aliases(F.col("doi"), F.col("url"))).alias("n", "alias")).select("rec_id", F.col("n").cast("bigint").alias("n"), "alias")


@query
def k_cache_keys(s, d):
    return _sources(s, d).select("rec_id", idy.cache_key(F.coalesce("title", F.lit("")), F.lit(8)).alias("cache_key"))


# text


@query
def t_sentences(s, d):
    return _sources(s, d).select("rec_id", F.posexplode(tx.sentences(F.col("content"))).alias("n", "sentence")).select("rec_id", F.col("n").cast("bigint").alias("n"), "sentence")


@query
def t_windows(s, d):
    return _sources(s, d).select("rec_id", F.posexplode(tx.windows(F.col("content"))).alias("n", "passage")).select("rec_id", F.col("n").cast("bigint").alias("n"), "passage")


@query
def t_keywords(s, d):
    return _evidence(s, d).where("claim IS NOT NULL").select("item_id", F.array_join(F.array_sort(tx.keywords(F.col("claim"))), " ").alias("keywords"))


@query
def t_title_forms(s, d):
    return _sources(s, d).where("title IS NOT NULL").select("rec_id", tx.title_form(F.col("title")).alias("title_form"), tx.word_form(F.col("title")).alias("word_form"))


@query
def t_author_lines(s, d):
    return _sources(s, d).select("rec_id", tx.authors_line(F.col("authors")).alias("line"))


@query
def t_cells(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", tx.cell(F.col("text"), 80).alias("cell"))


@query
def t_queries(s, d):
    return _evidence(s, d).where("claim IS NOT NULL").select("item_id", tx.clean_query(F.concat(F.lit("QUERY: \""), F.col("claim"), F.lit("\""))).alias("cleaned"))


@query
def t_key_passages(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", tx.key_passages(F.col("text")).alias("passages"))


@query
def t_inverted_index(s, d):
    w = _sources(s, d).where("content IS NOT NULL").select("rec_id", F.posexplode(F.split(tx.one_line(F.col("content")), " ")).alias("p", "w"))
    m = w.groupBy("rec_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("rec_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return m.select("rec_id", tx.from_inverted_index(F.col("m")).alias("content"))


@query
def t_title_overlap(s, d):
    x = ranked.with_rank(_sources(s, d).select("run_id", "pos", tx.words(F.coalesce("title", F.lit(""))).alias("a")), ["run_id"], ["pos"])
    before = x.select("run_id", (F.col("rank") + 1).alias("rank"), F.col("a").alias("b"))
    a = x.join(before, ["run_id", "rank"], "left")
    return a.select("run_id", "pos", F.round(tx.jaccard(F.col("a"), F.coalesce("b", F.array().cast("array<string>"))), 6).alias("overlap"))


# trust


@query
def s_tiers(s, d):
    x = _sources(s, d).withColumn("u", _web_url())
    return x.select("rec_id", trust.tier(F.col("u"), F.col("title"), F.col("content")).cast("bigint").alias("tier"), trust.is_junk(F.col("u"), F.col("title"), F.col("content")).alias("junk"))


@query
def s_tier_ranks(s, d):
    x = _sources(s, d).withColumn("u", _web_url()).withColumn("tier", trust.tier(F.col("u"), F.col("title"), F.col("content")).cast("bigint"))
    return ranked.with_rank(x.select("run_id", "rec_id", "tier", "pos"), ["run_id"], ["tier", "pos"]).select("run_id", "rec_id", "tier", "rank")


@query
def s_types(s, d):
    return _sources(s, d).select("rec_id", trust.source_type(F.col("publication_types"), F.col("venue"), F.col("url")).alias("source_type"))


@query
def s_relevant(s, d):
    return trust.relevant(_sources(s, d), F.lit(TOPIC), 2, lx.LITERATURE_STOP_WORDS, ["run_id"]).select("run_id", "rec_id")


@query
def s_relevant_loose(s, d):
    return trust.relevant(_sources(s, d), F.lit(TOPIC), 1, lx.TOPIC_STOP_WORDS, ["run_id"]).select("run_id", "rec_id")


@query
def s_usable(s, d):
    return trust.keep_all_if_none(_sources(s, d), F.coalesce(F.col("content"), F.lit("")) != "", ["run_id"]).select("run_id", "rec_id")


@query
def s_no_supplements(s, d):
    x = _sources(s, d).withColumn("u", F.when(F.col("rec_id") % 11 == 0, F.concat("url", F.lit("/MM1"))).otherwise(F.col("url")))
    return x.where(~F.endswith(F.lower(F.coalesce("u", F.lit(""))), F.lit("/mm1")) & ~F.endswith(F.lower(F.coalesce("title", F.lit(""))), F.lit(".pdf"))).select("rec_id")


@query
def s_metadata_scores(s, d):
    has = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0)
    authors = F.when(F.size("authors") > 0, 2).otherwise(0)
    return _sources(s, d).select("rec_id", (has("title") + authors + has("year") + has("doi") * 2 + has("content") * 2 + has("url")).cast("bigint").alias("score"))


# deduplication


@query
def d_web(s, d):
    x = _sources(s, d).withColumn("u", _web_url()).withColumn("tier", trust.tier(F.col("u"), F.col("title"), F.col("content"))).where("tier < 3").withColumn("c", idy.web_url(F.col("u")))
    return ordered.first_wins(x, ["run_id", "c"], ["pos"]).select("run_id", "rec_id", F.col("tier").cast("bigint").alias("tier"))


@query
def d_capped(s, d):
    x = _sources(s, d).withColumn("k", F.lower(tx.strip(F.coalesce("url", F.lit("")))))
    return ordered.first_wins(ordered.first_wins(x, ["run_id", "k"], ["pos"]), ["run_id"], ["pos"], 8).select("run_id", "rec_id")


@query
def d_doi(s, d):
    return ordered.first_wins_if_given(_sources(s, d), idy.literature_doi(F.col("doi")), ["run_id"], ["pos"]).select("run_id", "rec_id")


@query
def d_academic(s, d):
    """DOI, then address, then titles alike: a row dropped at a later stage has already claimed its earlier keys."""
    title = tx.strip(F.coalesce("title", F.lit("")))
    x = _sources(s, d).where((title != "") & ~F.lower(title).isin("untitled", "unknown title", "none", "no title"))
    x = ordered.first_wins_if_given(x, idy.dedup_doi(F.col("doi")), ["run_id"], ["pos"])
    x = ordered.first_wins_if_given(x, F.lower(tx.strip(F.coalesce("url", F.lit("")))), ["run_id"], ["pos"])
    x = ordered.durable(x.withColumn("o", F.struct("run_id", "pos")).withColumn("t", F.filter(F.split(tx.title_form(F.col("title")), " "), lambda w: w != "")))
    return ordered.alike_first_wins(x, ["run_id"], "o", "t", 0.85).select("run_id", "rec_id")


# joins


def _latest_profiles(s, d) -> DataFrame:
    p = table(s, d, "profiles")
    return p.groupBy("rec_id").agg(F.max_by(F.struct(*[c for c in p.columns if c != "rec_id"]), F.struct("checked_at", "profile_id")).alias("p")).select("rec_id", "p.*")


@query
def j_profiles(s, d):
    p = _latest_profiles(s, d).select("rec_id", "doi_verified", "is_retracted", "identity_status", "authors_match", "journal_name")
    return _sources(s, d).select("run_id", "pos", "rec_id").join(p, "rec_id", "left")


def _evidence_sources(s, d) -> DataFrame:
    """Evidence with the record it was taken from: by id, else by address."""
    both = _sources(s, d).select("rec_id", "url", "run_id").unionByName(table(s, d, "pinned_sources").select("rec_id", "url", F.lit(None).cast("string").alias("run_id")))
    by_id = both.select(F.concat(F.lit("source_"), F.col("rec_id").cast("string")).alias("k"), "rec_id")
    by_url = both.where("url <> ''").groupBy(F.col("url").alias("k")).agg(F.min("rec_id").alias("rec_id"))
    e = _evidence(s, d)
    return lookup.fallback_lookup(e, [(F.when(F.col("item_id") % 7 != 0, F.col("source_id")), by_id), (F.when(F.col("source_url") != "", F.col("source_url")), by_url)], "rec_id")


@query
def j_evidence_sources(s, d):
    return _evidence_sources(s, d).select("item_id", F.coalesce("rec_id", F.lit(0)).alias("rec_id"))


@query
def j_last_labels(s, d):
    return lookup.last_label(_evidence(s, d), table(s, d, "verdicts"), "verdict_id").select("item_id", "label", "confidence")


@query
def j_agreed_labels(s, d):
    e = _evidence(s, d).select("item_id", "evidence_id", "source_key", "source_url", "claim", F.lit(None).cast("string").alias("label"))
    return lookup.agreed_label(e, table(s, d, "verdicts"), idy.report_url).select("item_id", "label")


@query
def j_not_contradicted(s, d):
    """By claim alone, the last verdict counts; if nothing is left of a source, all of it stays."""
    v = table(s, d, "verdicts").where("claim <> ''").groupBy("claim").agg(F.max_by("label", "verdict_id").alias("last"))
    x = _evidence(s, d).join(v, "claim", "left")
    return trust.keep_all_if_none(x, F.coalesce(F.col("last"), F.lit("")) != "CONTRADICTION", ["source_id"]).select("source_id", "item_id")


@query
def j_new_works(s, d):
    known = _sources(s, d).select(idy.report_doi(F.col("doi")).alias("k")).where("k <> ''").distinct()
    return table(s, d, "registry_works").withColumn("k", idy.report_doi(F.col("doi"))).where("k <> ''").join(known, "k", "left_anti").select("work_id")


@query
def j_invented_dois(s, d):
    """Every item of evidence with the DOI it is given against all sources of its run."""
    texts = _run_evidence(s, d).select("run_id", F.concat(F.coalesce("evidence", F.lit("")), F.lit(" see "), F.coalesce("doi", F.lit("")), F.lit(".")).alias("t"))
    return citations.invented_dois(texts, _run_sources(s, d), "run_id", "t").distinct()


@query
def j_unverified(s, d):
    return _evidence(s, d).select("item_id", "evidence_id").join(table(s, d, "verdicts").select("evidence_id"), "evidence_id", "left_anti").select("item_id")


@query
def j_batches(s, d):
    x = ranked.with_rank(_evidence(s, d).select("item_id", "source_key"), ["source_key"], ["item_id"])
    return x.select("item_id", "source_key", F.floor((F.col("rank") - 1) / 5).alias("batch"))


@query
def j_merged_providers(s, d):
    """Sources of all providers in a fixed order of priority, then by place."""
    rank = F.when(F.col("source") == "Semantic Scholar", 0).when(F.col("source") == "OpenAlex", 1).when(F.col("source") == "Crossref", 2).otherwise(3)
    x = _sources(s, d).select("run_id", "rec_id", "pos", rank.alias("prio"))
    return ranked.with_rank(x, ["run_id"], ["prio", "pos"], "place").select("run_id", "rec_id", "place")


@query
def j_valid_gaps(s, d):
    """Proposals, one a titled source, that are long enough and like no source title of their run; ``h_valid_gaps`` has all conditions."""
    x = _sources(s, d).where("title <> ''")
    ok = F.size(F.filter(F.split(tx.strip(F.coalesce("content", F.lit(""))), r"\s+"), lambda w: w != "")) >= 8
    props = x.where(ok).select("run_id", "rec_id", F.array_sort(tx.words(F.concat_ws(" ", F.lit("extending"), F.col("title")))).alias("t"))
    like = ordered.like_any(props, x.select("run_id", tx.words(F.col("title")).alias("t")), ["run_id"], "t", 0.65)
    return props.join(like, ["run_id", "t"], "left_anti").select("rec_id")


# aggregates


@query
def a_label_summary(s, d):
    return verdicts.summary(table(s, d, "verdicts"))


@query
def a_quality_audit(s, d):
    p = _latest_profiles(s, d)
    return p.agg(F.count("*").alias("papers"), F.count_if("doi_verified").alias("doi_verified"), F.count_if("is_retracted").alias("retracted"), F.count_if(F.col("confidence_level") == "HIGH").alias("high"))


@query
def a_claim_buckets(s, d):
    x = lookup.last_label(_evidence(s, d), table(s, d, "verdicts"), "verdict_id").where("source_key <> '' AND claim <> ''")
    firsts = x.groupBy("source_key", F.upper(F.coalesce("label", F.lit("UNVERIFIED"))).alias("label"), "claim").agg(F.min("item_id").alias("i"))
    firsts = ordered.durable(firsts)
    few = ordered.first_wins(firsts, ["source_key", "label"], ["i"], 3).groupBy("source_key", "label").agg(F.array_sort(F.collect_list(F.struct("i", "claim"))).alias("few"))
    n = firsts.groupBy("source_key", "label").agg(F.count("*").alias("claims"))
    return n.join(few, ["source_key", "label"]).select("source_key", "label", "claims", F.array_join(F.transform("few", lambda v: v["claim"]), " / ").alias("shown"))


@query
def a_indexes(s, d):
    return _evidence(s, d).groupBy("source_key").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("verified_indexes")))), "; ").alias("indexes"), F.count_if("is_retracted").alias("retracted"))


# registries


def _two_registries(s, d) -> DataFrame:
    """Every paper with the record either registry has of its DOI; papers without one meet none."""
    papers = _sources(s, d).withColumn("k", F.nullif(idy.report_doi(F.col("doi")), F.lit("")))
    w = table(s, d, "registry_works").withColumn("k", idy.report_doi(F.col("doi"))).where("k <> ''")
    def one(name: str, p: str) -> DataFrame:
        g = ordered.first_wins(w.where(F.col("registry") == name), ["k"], ["work_id"])
        return g.select("k", F.col("work_id").alias(f"{p}_id"), F.col("title").alias(f"{p}_title"), F.col("authors").alias(f"{p}_authors"), F.col("container_title").alias(f"{p}_journal"))
    return papers.join(one("openalex", "oa"), "k", "left").join(one("crossref", "cr"), "k", "left")


def _statuses(x: DataFrame) -> DataFrame:
    http = lambda n: F.when((F.col("rec_id") + n) % 5 == 0, 429).when((F.col("rec_id") + n) % 5 == 1, 500).when((F.col("rec_id") + n) % 5 == 2, F.lit(None)).otherwise(404)
    return x.withColumn("oa_status", registry.status(F.col("oa_id").isNotNull(), http(0))).withColumn("cr_status", registry.status(F.col("cr_id").isNotNull(), http(2)))


@query
def r_statuses(s, d):
    return _statuses(_two_registries(s, d)).select("rec_id", "oa_status", "cr_status")


def _decided(s, d, sequence: bool, rule=registry.decide) -> DataFrame:
    x = _statuses(_two_registries(s, d))
    sim = lambda a, b: F.coalesce(registry.token_similarity(F.col(a), F.col(b), sequence), F.lit(0.0))
    x = x.withColumn("sim_oa", sim("title", "oa_title")).withColumn("sim_cr", sim("title", "cr_title"))
    x = x.withColumn("sim_both", sim("oa_title", "cr_title"))
    p_oa, p_cr = registry.authors_overlap(F.col("authors"), F.col("oa_authors")), registry.authors_overlap(F.col("authors"), F.col("cr_authors"))
    between = registry.authors_overlap(F.col("oa_authors"), F.col("cr_authors"))
    no = lambda c: F.coalesce(~c, F.lit(False))
    has = F.size(F.coalesce("authors", F.array().cast("array<string>"))) > 0
    match = F.when(no(between) | (has & (no(p_oa) | no(p_cr))), F.lit(False)).when(has & (F.coalesce(between, F.lit(False)) | F.coalesce(p_oa, F.lit(False)) | F.coalesce(p_cr, F.lit(False))), F.lit(True))
    given = (F.coalesce("oa_journal", F.lit("")) != "") & (F.coalesce("cr_journal", F.lit("")) != "") & ~F.lower(F.trim(F.coalesce("venue", F.lit("")))).isin("", "unknown", "none")
    ebook = F.contains(F.lower(F.concat_ws(" ", "oa_journal", "cr_journal", "venue")), F.lit("ebook"))
    journal = F.when(given & ~ebook, registry.journal_similarity(F.col("oa_journal"), F.col("cr_journal"), sequence) >= 0.55)
    retracted = _latest_profiles(s, d).select("rec_id", F.col("is_retracted"))
    x = x.withColumn("authors_match", match).withColumn("journal_match", journal).join(retracted, "rec_id", "left")
    return rule(x)


@query
def r_decisions(s, d):
    """Titles are compared by their tokens, which SQL can express; ``r_decisions_full`` adds character similarity."""
    return _decided(s, d, False).select("rec_id", "oa_status", "cr_status", "title_similarity", "authors_match", "journal_match", "confidence", "agreement", "identity_status")


@query
def r_decisions_full(s, d):
    return _decided(s, d, True).select("rec_id", "title_similarity", "confidence", "agreement", "identity_status")


@query
def r_identity(s, d):
    agreement = F.when(F.col("metadata_agreement") == "FULL", "HIGH").otherwise(F.col("metadata_agreement"))
    return table(s, d, "profiles").select("profile_id", registry.identity_status(F.col("is_retracted"), F.col("metadata_agreement") == "CONFLICT", F.col("confidence_level"), agreement).alias("identity_status"))


# reports


def _reports(s, d) -> DataFrame:
    return table(s, d, "documents").where("doc_kind IN ('report', 'analysis', 'table') AND text IS NOT NULL")


@query
def x_audit(s, d):
    return citations.audit(_reports(s, d), F.lit(9))


@query
def x_inline_counts(s, d):
    return _reports(s, d).select("doc_id", citations.inline_count(F.col("text")).alias("markers"), F.length(citations.body_of(F.col("text"))).cast("bigint").alias("body_length"))


@query
def x_scores(s, d):
    r = _reports(s, d)
    a = citations.audit(r, F.lit(9)).select("doc_id", "eligible", "cited")
    x = r.join(a, "doc_id")
    cov = F.when(F.col("eligible") > 0, F.col("cited") / F.col("eligible")).otherwise(0.0)
    x = x.select(
        "doc_id", F.round(scorecard.section_share(F.col("text")), 6).alias("sections"), F.round(cov, 6).alias("coverage"),
        scorecard.density(F.col("cited"), F.col("text")).alias("density"), scorecard.diversity(F.col("doc_id") % 13, F.col("doc_id") % 9).alias("diversity"), scorecard.gap_acknowledged(F.col("text")).alias("gap"),
    )
    judge = F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 10 + 1).cast("double"))
    c = [F.col(n) for n in ("sections", "coverage", "diversity", "density", "gap")]
    return x.select("*", scorecard.overall(*c).alias("rule_score"), scorecard.overall(*c, judge).alias("overall"))


@query
def x_ablation(s, d):
    v = table(s, d, "verdicts").select(F.upper("label").alias("topic"), F.when(F.col("verdict_id") % 2 == 0, "VERIFICATION_ON").otherwise("VERIFICATION_OFF").alias("mode"), F.coalesce("confidence", F.lit(0.0)).alias("v"))
    out = scorecard.ablation(v, "topic", "mode", "v")
    return out.select("topic", F.col("VERIFICATION_OFF").alias("verification_off"), F.col("VERIFICATION_ON").alias("verification_on"))


@query
def x_citation_numbers(s, d):
    return citations.citation_numbers(_sources(s, d).select("run_id", "pos", "doi", "url"), "run_id", "pos")


# labels


@query
def v_interpreted(s, d):
    v = table(s, d, "verdicts").where("confidence IS NOT NULL")
    name = F.when(F.col("verdict_id") % 3 == 0, F.when(F.upper("label") == "CONTRADICTION", "LABEL_0").when(F.upper("label") == "ENTAILMENT", "LABEL_1").otherwise("LABEL_2")).otherwise(F.col("label"))
    scores = F.array(F.struct(name.alias("label"), F.col("confidence").alias("score")), F.struct(F.lit("other").alias("label"), (1 - F.col("confidence")).alias("score")))
    out = v.select("verdict_id", verdicts.interpret(scores, 0.70).alias("r"))
    return out.select("verdict_id", "r.label", F.round("r.score", 6).alias("score"))


@query
def v_rule_labels(s, d):
    out = _evidence(s, d).select("item_id", verdicts.rule_label(F.col("claim"), F.col("evidence")).alias("r"))
    return out.select("item_id", "r.label", F.col("r.score").alias("score"))


# caches


@query
def m_cached_profiles(s, d):
    p = fresh(table(s, d, "profiles"), "checked_at", F.lit(NOW).cast("timestamp"), 168 * 24)
    return p.select("profile_id", "hit")


@query
def m_reviewed_profiles(s, d):
    """Cached profiles under the present rules: a strong identity clears a conflict."""
    p = table(s, d, "profiles")
    strong = (F.col("title_similarity") >= 0.80) & F.coalesce("authors_match", F.lit(False)) & (F.col("openalex_status") == "VERIFIED") & (F.col("crossref_status") == "VERIFIED")
    strong = F.coalesce(strong, F.lit(False))
    agreement = F.when(strong & (F.col("metadata_agreement") == "CONFLICT"), "MODERATE").otherwise(F.col("metadata_agreement"))
    level = F.when(strong & (F.col("confidence_level") == "LOW"), "MEDIUM").otherwise(F.col("confidence_level"))
    return p.select("profile_id", agreement.alias("metadata_agreement"), level.alias("confidence_level"))


# retrieval and consensus


#: The scope of evidence from pinned sources. Every run cites these, so such an item belongs to no single run; it is judged once, for all of them.
PINNED = "pinned"


def _with_sources(s, d, e: DataFrame, *cols) -> DataFrame:
    """``e`` with columns of the record that ``source_id`` names, in academic_sources or pinned_sources; no record is in both.

    A pinned source may hold a tenth of all rows, so the few pinned ones are broadcast and their rows never meet in one task.
    """
    key = F.concat(F.lit("source_"), F.col("rec_id").cast("string")).alias("source_id")
    pinned = F.broadcast(table(s, d, "pinned_sources").withColumn("run_id", F.lit(PINNED)).select(key, *cols))
    rest = e.join(F.broadcast(pinned.select("source_id")), "source_id", "left_anti")
    return rest.join(_sources(s, d).select(key, *cols), "source_id").unionByName(e.join(pinned, "source_id"))


def _run_evidence(s, d) -> DataFrame:
    """Evidence with the run, DOI and address of its source; items from pinned sources are in the scope ``PINNED``."""
    return _with_sources(s, d, _evidence(s, d), "rec_id", "run_id", F.col("doi").alias("sdoi"), F.col("url").alias("surl"), F.col("title").alias("stitle"))


def _run_sources(s, d) -> DataFrame:
    """The sources of each run: its own, then the pinned ones, which every run and the scope ``PINNED`` have."""
    cols = ["rec_id", "run_id", "pos", "doi", "url", "title", "content"]
    own = _sources(s, d).withColumn("pos", F.col("pos").cast("bigint")).select(*cols)
    runs = own.select("run_id").where("run_id IS NOT NULL").distinct().unionByName(s.range(1).select(F.lit(PINNED).alias("run_id")))
    pinned = runs.crossJoin(F.broadcast(table(s, d, "pinned_sources"))).withColumn("pos", F.lit(1 << 40) + F.col("rec_id")).select(*cols)
    p = _latest_profiles(s, d).select("rec_id", "is_retracted")
    return own.join(p, "rec_id", "left").unionByName(pinned.withColumn("is_retracted", F.lit(None).cast("boolean"))).withColumn("source_id", F.col("rec_id"))


def _claims(s, d) -> DataFrame:
    """Each claim of each run once, by its first item."""
    x = ordered.first_wins(_run_evidence(s, d).where("claim <> ''"), ["run_id", "claim"], ["item_id"])
    return x.select("run_id", F.col("item_id").alias("claim_id"), "claim")


@query
def c_prefilter(s, d):
    return retrieval.prefilter(_claims(s, d), _run_sources(s, d), ["run_id"]).select("claim_id", "source_id")


@query
def c_best_passages(s, d):
    claims, sources = _claims(s, d), _run_sources(s, d).where("content <> ''")
    pairs = retrieval.prefilter(claims, sources, ["run_id"])
    return retrieval.best_passages(pairs, claims, sources).select("claim_id", "source_id", F.col("window").cast("bigint").alias("window"), "passage", "score")


@query
def c_nearest(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.nearest(q, e)


@query
def c_core_claims(s, d):
    return consensus.core_claims(_run_evidence(s, d), table(s, d, "verdicts")).select("run_id", "item_id", "claim")


def _profiles(s, d) -> DataFrame:
    core = consensus.core_claims(_run_evidence(s, d), table(s, d, "verdicts"))
    sources = _run_sources(s, d)
    cid, key = idy.canonical_id(F.col("sdoi"), F.col("surl"), F.col("stitle")), idy.source_key(F.col("sdoi"), F.col("surl"), F.col("stitle"))
    claims = core.select("run_id", F.col("item_id").alias("claim_id"), "claim", "evidence", "rec_id", cid.alias("cid"), key.alias("skey"), F.col("is_retracted").alias("said_retracted"))
    gone = sources.where("is_retracted").select("run_id", idy.canonical_id(F.col("doi"), F.col("url"), F.col("title")).alias("cid")).distinct().withColumn("gone", F.lit(True))
    claims = claims.join(gone, ["run_id", "cid"], "left").withColumn("is_retracted", F.coalesce("said_retracted", F.lit(False)) | F.coalesce("gone", F.lit(False)))
    claims = ordered.durable(claims)
    return consensus.profiles(claims, consensus.assess(claims, sources))


@query
def c_consensus(s, d):
    return _profiles(s, d)


@query
def c_histogram(s, d):
    return _profiles(s, d).groupBy("verdict").agg(F.count("*").alias("claims"))


@query
def c_table_rows(s, d):
    """Rows of the consensus table of each run."""
    p = _profiles(s, d)
    n = F.row_number().over(W.partitionBy("run_id").orderBy("claim_id"))
    short = F.when(F.length("claim") > 60, F.concat(F.substring("claim", 1, 60), F.lit("..."))).otherwise(F.col("claim"))
    row = F.format_string("| [%d] | %s | %d | %d | %d | %s |", n, short, F.col("supporting"), F.col("contradicting"), F.col("alerts"), F.col("verdict"))
    return p.select("run_id", "claim_id", row.alias("row"))


# rendering


@query
def z_quality_rows(s, d):
    p = table(s, d, "profiles")
    return p.select("profile_id", render.quality_row(F.col("profile_id") % 100).alias("row"))


@query
def z_literature_tables(s, d):
    """The literature table of each run's first eight sources."""
    v = lookup.agreed_label(_evidence(s, d).select("source_id", "item_id", "evidence_id", "source_key", "source_url", "claim", F.lit(None).cast("string").alias("label")), table(s, d, "verdicts"), idy.report_url)
    good = v.where("label = 'ENTAILMENT' AND claim <> ''").groupBy("source_id", "claim").agg(F.min("item_id").alias("i"))
    good = ordered.first_wins(good, ["source_id"], ["i"], 3).groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "claim"))), lambda x: x["claim"]).alias("claims"))
    x = ordered.first_wins(_sources(s, d), ["run_id"], ["pos"], 8).withColumn("source_id", F.concat(F.lit("source_"), F.col("rec_id").cast("string"))).join(good, "source_id", "left")
    n = F.row_number().over(W.partitionBy("run_id").orderBy("pos"))
    rows = x.withColumn("n", n).withColumn("row", render.literature_row(F.col("n"), F.coalesce("claims", F.array().cast("array<string>"))))
    return render.joined(rows, "run_id", "n", "row")


@query
def z_source_lists(s, d):
    x = ordered.first_wins(_sources(s, d), ["run_id"], ["pos"], 12).withColumn("n", F.row_number().over(W.partitionBy("run_id").orderBy("pos")))
    return render.joined(x.withColumn("row", render.source_entry(F.col("n"))), "run_id", "n", "row")


@query
def z_audit_texts(s, d):
    a = citations.audit(_reports(s, d), F.lit(9))
    return a.select("doc_id", render.audit_text(F.col("eligible"), F.col("cited"), F.col("coverage_percent"), F.col("invalid_markers"), F.col("total_markers")).alias("text"))


# quotations


def _quoted(s, d) -> DataFrame:
    return _with_sources(s, d, _evidence(s, d).select("item_id", "source_id", "evidence"), "title", "content")


@query
def q_in_source(s, d):
    return _quoted(s, d).select("item_id", quotes.found_in_source(F.col("evidence"), F.col("title"), F.col("content")).alias("found"))


@query
def q_recovered(s, d):
    return quotes.with_recovered(_quoted(s, d), "evidence", "content", "passage").select("item_id", "passage")


@query
def q_match_forms(s, d):
    return _evidence(s, d).select("item_id", quotes.matching_form("evidence").alias("form"))
