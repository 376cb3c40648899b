"""What comes from outside: searches, registries, models. Each is a small protocol with a deterministic offline default."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 16
CLAIM_CHARS, EVIDENCE_CHARS = 256, 1024


class Scorer(Protocol):
    """A classifier of claim-passage pairs."""

    def __call__(self, pairs: list[tuple[str, str]]) -> list[list[tuple[str, float]]]: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class TextProvider(Protocol):
    """A language model; gives ``default`` when it fails."""

    def __call__(self, prompt: str, default: str) -> str: ...


class Search(Protocol):
    """Rows of sources for a query, in order; an empty list when it fails."""

    def __call__(self, query: str, most: int) -> list[dict]: ...


class Extractor(Protocol):
    """Quotes and claims from a few sources (``source_id, title, content``): rows with source_id, evidence and claim."""

    def __call__(self, sources: list[dict]) -> list[dict]: ...


class RegistrySource(Protocol):
    """How a registry answered for a DOI (VERIFIED, NOT_FOUND, RATE_LIMITED, TIMEOUT, UNAVAILABLE) and its record as JSON."""

    def __call__(self, doi: str) -> tuple[str, str | None]: ...


def rule_scorer(pairs: list[tuple[str, str]]) -> list[list[tuple[str, float]]]:
    """Share of the claim's words in the passage; the offline default, no model."""
    out = []
    for claim, passage in pairs:
        c, p = (set(re.findall(r"[a-z]{3,}", x.lower())) for x in (claim, passage))
        s = round(len(c & p) / len(c), 3) if c else 0.0
        turned = bool({"not", "never"} & set(claim.lower().split())) != bool({"not", "never"} & set(passage.lower().split()))
        out.append([("CONTRADICTION" if turned else "ENTAILMENT", s), ("NEUTRAL", round(1 - s, 3))])
    return out


def hash_embedder(texts: list[str], size: int = 64) -> list[list[float]]:
    """Normalised hashed bags of words; the offline default, no model."""
    out = []
    for t in texts:
        v = [0.0] * size
        for w in re.findall(r"\w+", t.lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % size] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / n for x in v])
    return out


def no_text(prompt: str, default: str) -> str:
    return default


def no_results(query: str, most: int) -> list[dict]:
    return []


def no_extraction(sources: list[dict]) -> list[dict]:
    return []


def no_record(doi: str) -> tuple[str, str | None]:
    return "UNAVAILABLE", None


def first_that_answers(searches: Iterable[Search], query: str, most: int, tries: int = 1) -> list[dict]:
    """The rows of the first search that has any, each tried ``tries`` times; failures count as no rows."""
    for search in searches:
        for _ in range(tries):
            try:
                rows = search(query, most)
            except Exception:  # noqa: BLE001  a source that fails is a source without rows
                rows = []
            if rows:
                return rows[:most]
    return []


def score_pairs(df: DataFrame, key: str, claim: str, passage: str, scorer: Callable[[], Scorer] = lambda: rule_scorer) -> DataFrame:
    """``(key, scores, status)`` of each pair.

    ``scorer`` makes the model, once a task. Pairs go through it in batches of near length; a batch that fails is tried pair by pair,
    and a pair that fails has no scores and the status ``failed``. Blank pairs are ``blank``.
    """
    x = df.select(F.col(key).alias("key"), F.substring(F.coalesce(claim, F.lit("")), 1, CLAIM_CHARS).alias("c"), F.substring(F.coalesce(passage, F.lit("")), 1, EVIDENCE_CHARS).alias("p"))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer()
        for pdf in batches:
            scores: list = [None] * len(pdf)
            status = ["blank"] * len(pdf)
            rows = [i for i, (c, p) in enumerate(zip(pdf["c"], pdf["p"])) if c.strip() and p.strip()]
            for at in range(0, len(rows), BATCH):
                part = rows[at : at + BATCH]
                pairs = [(pdf["c"][i], pdf["p"][i]) for i in part]
                try:
                    got: list = model(pairs)
                except Exception:  # noqa: BLE001
                    got = []
                    for pair in pairs:
                        try:
                            got.append(model([pair])[0])
                        except Exception:  # noqa: BLE001
                            got.append(None)
                for i, g in zip(part, got):
                    status[i] = "failed" if g is None else "ok"
                    scores[i] = None if g is None else [{"label": a, "score": float(b)} for a, b in g]
            yield pd.DataFrame({"key": pdf["key"], "scores": scores, "status": status})

    ordered = x.sortWithinPartitions(F.length("c") + F.length("p"))
    return ordered.mapInPandas(run, f"key {kind}, scores array<struct<label:string,score:double>>, status string").withColumnRenamed("key", key)
