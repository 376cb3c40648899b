"""The steps of a run that need a model or a search, each as a function from frames to a frame.

A provider is made once a task and called once a row; what it raises, or an answer that can't be read, gives the step's default and the
status ``failed``, never an error. The offline defaults answer nothing, so every step works without a network.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators import citations, harvest, intake
from attesta.operators.scorecard import JUDGED, judge_average
from attesta.sources.providers import Extractor, RegistrySource, Search, TextProvider, no_extraction, no_record, no_results, no_text

# How much of a text a step shows to a model, and what decides about another round.
SUMMARY_CHARS, ANALYSIS_CHARS, GAP_CHARS, JUDGE_CHARS = 800, 1500, 400, 4000
SUFFICIENT, MORE = "SUFFICIENT", "MORE_RESEARCH"

_SOURCE = "array<struct<title:string,url:string,content:string,source:string>>"


def ask(df: DataFrame, prompt: Column, provider: Callable[[], TextProvider] = lambda: no_text, default: str = "", out: str = "answer") -> DataFrame:
    """``df`` with the answer to a prompt and its ``status``: ok, blank (an empty prompt) or failed (the default is given)."""
    x = df.withColumn("__prompt", F.coalesce(prompt, F.lit("")))
    names = [c for c in df.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for pdf in batches:
            answers, status = [], []
            for p in pdf["__prompt"]:
                if not p.strip():
                    answers.append(default)
                    status.append("blank")
                    continue
                try:
                    answers.append(str(model(p, default)))
                    status.append("ok")
                except Exception:  # noqa: BLE001  a model that fails is a model without an answer
                    answers.append(default)
                    status.append("failed")
            yield pdf[names].assign(**{out: answers, "status": status})

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return x.mapInPandas(run, f"{fields}, `{out}` string, status string")


def search(df: DataFrame, query: Column, provider: Callable[[], Search] = lambda: no_results, most: int = 8) -> DataFrame:
    """``df`` with one row a hit: ``pos`` and the hit's title, url, content and source. Failures are queries without hits."""
    x = df.withColumn("__query", F.coalesce(query, F.lit("")))
    names = [c for c in df.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = provider()
        for pdf in batches:
            hits = []
            for q in pdf["__query"]:
                try:
                    got = find(q, most)[:most] if q.strip() else []
                except Exception:  # noqa: BLE001
                    got = []
                hits.append([{k: None if h.get(k) is None else str(h[k]) for k in ("title", "url", "content", "source")} for h in got])
            yield pdf[names].assign(hits=hits)

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    out = x.mapInPandas(run, f"{fields}, hits {_SOURCE}")
    return out.select(*names, F.posexplode("hits").alias("pos", "h")).select(*names, "pos", "h.*")


def shown(sources: DataFrame, chars: int, most: int, scope: str = "run_id") -> DataFrame:
    """``(scope, shown)``: the first ``most`` sources of each run with the beginning of their content, numbered, as a prompt shows them."""
    from attesta.operators.ordered import first_wins

    line = F.concat(F.lit("["), (F.col("pos") + 1).cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.substring(F.coalesce("content", F.lit("")), 1, chars))
    few = first_wins(sources, [scope], ["pos"], most).withColumn("line", line)
    return few.groupBy(scope).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n\n").alias("shown"))


def initial_query(runs: DataFrame, provider: Callable[[], TextProvider] = lambda: no_text) -> DataFrame:
    """Runs with their first search ``query``: the model's, cleaned, or the topic's own words."""
    x = ask(runs, F.concat(F.lit("Write one search query for the topic: "), F.col("topic")), provider, out="said")
    q = tx.clean_query(F.col("said"))
    return x.withColumn("query", F.when(q != "", q).otherwise(tx.clean_query(F.col("topic")))).drop("said", "status")


def research(runs: DataFrame, finder: Callable[[], Search] = lambda: no_results, provider: Callable[[], TextProvider] = lambda: no_text, known: DataFrame | None = None, most: int = 5) -> DataFrame:
    """The web sources of each run: the hits of its query without junk, after those known from an earlier round."""
    hits = search(initial_query(runs, provider).select("run_id", "query"), F.col("query"), finder, most).drop("query")
    found = harvest.web_results(hits).drop("tier")
    return found if known is None else harvest.merged_sources(known.select(*found.columns), found)


def summaries(runs: DataFrame, sources: DataFrame, provider: Callable[[], TextProvider] = lambda: no_text) -> DataFrame:
    """Runs with a ``summary`` of their sources; '' where there is no source or no answer."""
    x = runs.join(shown(sources, SUMMARY_CHARS, 12), "run_id", "left")
    return ask(x, F.when(F.col("shown") != "", F.concat(F.lit("Summarise what these sources say of "), F.col("topic"), F.lit(":\n\n"), F.col("shown"))), provider, out="summary").drop("shown", "status")


def gaps(runs: DataFrame, provider: Callable[[], TextProvider] = lambda: no_text) -> DataFrame:
    """Runs (with ``summary``) with the ``gap`` a model sees and the ``query`` that would close it, anchored in the topic."""
    x = ask(runs, F.concat(F.lit("Name one gap as GAP: and one query as QUERY: in\n"), F.col("summary")), provider, out="said")
    return x.withColumn("__g", intake.gap_and_query(F.col("said"), F.col("topic"))).select(*runs.columns, "__g.gap", "__g.query")


def literature(runs: DataFrame, finders: list[tuple[str, Callable[[], Search]]], most: int = 8) -> DataFrame:
    """The academic sources of each run (with ``query``) from all providers in their order of priority, without copies."""
    out = None
    for name, finder in finders:
        hits = search(runs.select("run_id", "query"), F.col("query"), finder, most).withColumn("source", F.lit(name))
        out = hits if out is None else out.unionByName(hits)
    x = out.withColumn("doi", F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)doi\.org/(10\.[0-9]{4,9}/\S+)", 1))
    return harvest.merged_search(x, F.lit(False))


def analyses(runs: DataFrame, sources: DataFrame, provider: Callable[[], TextProvider] = lambda: no_text) -> DataFrame:
    """Runs with an ``analysis`` of their literature. One that names a DOI no source has is asked for once more; lines with such a DOI that are left go."""
    x = runs.join(shown(sources, ANALYSIS_CHARS, 8), "run_id", "left")
    request = F.when(F.col("shown") != "", F.concat(F.lit("Analyse the literature on "), F.col("topic"), F.lit(":\n\n"), F.col("shown")))
    first = ask(x, request, provider, out="analysis").drop("status")
    made_up = lambda a: citations.invented_dois(a.select("run_id", "analysis"), sources, "run_id", "analysis").groupBy("run_id").agg(F.collect_set("doi").alias("invented"))
    judged = first.join(made_up(first), "run_id", "left")
    good, bad = judged.where("invented IS NULL"), judged.where("invented IS NOT NULL")
    again = ask(bad.drop("analysis"), F.concat(request, F.lit("\n\nUse no other DOI than those above; these do not exist: "), F.array_join("invented", ", ")), provider, out="analysis").drop("status", "invented")
    kept = again.join(made_up(again), "run_id", "left")
    none = F.array().cast("array<string>")
    kept = kept.withColumn("analysis", citations.without_lines_of(F.col("analysis"), F.coalesce("invented", none)))
    cols = [*runs.columns, "analysis"]
    return good.select(*cols).unionByName(kept.select(*cols))


def extracted(sources: DataFrame, extractor: Callable[[], Extractor] = lambda: no_extraction, batch: int = 5) -> DataFrame:
    """Evidence ``(run_id, item_id, source_id, evidence, claim)`` that a model quotes from each source and that is in it, word by word or as its nearest passage."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = extractor()
        for pdf in batches:
            rows = []
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                try:
                    got = read([dict(zip(part.columns, r)) for r in part.itertuples(index=False)])
                except Exception:  # noqa: BLE001
                    got = []
                rows += [(str(g.get("source_id")), g.get("evidence"), g.get("claim")) for g in got]
            yield pd.DataFrame(rows, columns=["source_id", "evidence", "claim"])

    said = sources.select("source_id", "title", "content").mapInPandas(run, "source_id string, evidence string, claim string")
    said = said.withColumn("item_id", F.xxhash64("source_id", "evidence", "claim"))
    good = intake.accepted_extractions(said, sources.select("source_id", "content"))
    return good.join(sources.select("source_id", "run_id"), "source_id").select("run_id", "item_id", "source_id", "evidence", "claim")


def criticised(runs: DataFrame, provider: Callable[[], TextProvider] = lambda: no_text) -> DataFrame:
    """Runs (with ``summary``) with a critic's ``decision`` and ``follow_up``; what can't be read is SUFFICIENT, so a run ends."""
    x = ask(runs, F.concat(F.lit("Answer as JSON with decision and query: is this enough?\n"), F.col("summary")), provider, default="{}", out="said")
    said = F.from_json("said", "struct<decision:string,query:string>")
    more = F.coalesce(F.upper(said["decision"]) == MORE, F.lit(False))
    q = intake.follow_up(F.coalesce(said["query"], F.lit("")), F.col("topic"))
    return x.withColumn("decision", F.when(more & (q != ""), MORE).otherwise(SUFFICIENT)).withColumn("follow_up", F.when(more, q).otherwise("")).select(*runs.columns, "decision", "follow_up")


def report_bodies(runs: DataFrame, provider: Callable[[], TextProvider] = lambda: no_text) -> DataFrame:
    """Runs (with ``summary`` and ``gap``) with the ``body`` of their report; without an answer it is made of these."""
    own = F.concat(F.lit("## 1. Summary\n\n"), F.coalesce("summary", F.lit("")), F.lit("\n\n## 5. Knowledge Gaps\n\n"), F.coalesce("gap", F.lit("")), F.lit("\n\n## 6. Recommendations\n\n"))
    x = ask(runs, F.concat(F.lit("Write a report on "), F.col("topic"), F.lit("\n\n"), F.col("summary")), provider, out="said")
    return x.withColumn("body", F.when(tx.strip("said") != "", F.col("said")).otherwise(own)).select(*runs.columns, "body")


_REC = "array<struct<title:string,novelty:string,difficulty:string,gap:string,approach:string>>"


def recommended(runs: DataFrame, titles: DataFrame, provider: Callable[[], TextProvider] = lambda: no_text) -> DataFrame:
    """``(run_id, pos, title, novelty, difficulty, gap, approach)``: a model's proposals that are long enough and like no source title of their run."""
    from attesta.operators.ordered import like_any

    x = ask(runs, F.concat(F.lit("Propose directions as a JSON list for "), F.col("topic")), provider, default="[]", out="said")
    r = x.select("run_id", F.posexplode(F.from_json("said", _REC)).alias("pos", "r")).select("run_id", "pos", "r.*")
    count = lambda c: F.size(F.filter(F.split(tx.one_line(F.coalesce(c, F.lit(""))), " "), lambda w: w != ""))
    r = r.where((count("gap") >= 8) & (count("approach") >= 8) & ~F.contains("gap", F.lit("Novelty =")) & ~F.contains("gap", F.lit("Difficulty =")))
    r = r.withColumn("t", F.array_sort(tx.words(F.coalesce("title", F.lit("")))))
    like = like_any(r.select("run_id", "t"), titles.select("run_id", tx.words(F.col("title")).alias("t")), ["run_id"], "t", 0.65)
    return r.join(like, ["run_id", "t"], "left_anti").drop("t")


def gap_sources(runs: DataFrame, finder: Callable[[], Search] = lambda: no_results, most: int = 6) -> DataFrame:
    """What two queries for open problems of each run's topic find, each address once."""
    q = runs.select("run_id", F.posexplode(harvest.gap_queries(F.col("topic"))).alias("query", "__q"))
    return harvest.gap_hits(search(q, F.col("__q"), finder, most).drop("__q"))


def judged(reports: DataFrame, provider: Callable[[], TextProvider] = lambda: no_text) -> DataFrame:
    """Reports (``run_id, text``) with a judge's five ``scores`` and their ``average``; NULL where the judge fails or scores beyond 1 to 10."""
    fields = ",".join(f"{n}:int" for n in JUDGED)
    x = ask(reports, F.concat(F.lit("Score as JSON: "), F.lit(json.dumps(JUDGED)), F.lit("\n"), F.substring("text", 1, JUDGE_CHARS)), provider, default="{}", out="said")
    scores = F.from_json("said", f"struct<{fields}>")
    average = judge_average(scores)
    return x.select(*reports.columns, F.when(average.isNotNull(), scores).alias("scores"), average.alias("average"))


def registry_records(papers: DataFrame, source: Callable[[], RegistrySource] = lambda: no_record, key: str = "doi") -> DataFrame:
    """``(key, status, json)`` of each DOI once: what a registry answers, or how it failed to."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look_up = source()
        for pdf in batches:
            rows = []
            for k in pdf[key]:
                try:
                    status, record = look_up(k)
                except TimeoutError:
                    status, record = "TIMEOUT", None
                except Exception:  # noqa: BLE001
                    status, record = "UNAVAILABLE", None
                rows.append((k, status, record))
            yield pd.DataFrame(rows, columns=[key, "status", "json"])

    return papers.select(key).where(F.coalesce(key, F.lit("")) != "").distinct().mapInPandas(run, f"{key} string, status string, json string")


def full_texts(sources: DataFrame, fetch: Callable[[], TextProvider] = lambda: no_text, least: int = 2000) -> DataFrame:
    """Sources with ``full_text``: the key passages of the text behind their DOI if it has more than ``least`` characters, else ''."""
    x = ask(sources, F.col("doi"), fetch, out="__text").drop("status")
    return x.withColumn("full_text", F.when(F.length("__text") > least, tx.key_passages(F.col("__text"))).otherwise("")).drop("__text")
