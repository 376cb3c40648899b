"""Finding quotations in their sources.

Containment, windows of characters and the passages of a text are column expressions. Only compatibility forms of text that is not
ASCII and the comparison of a quotation with the few passages that can be near it run in Python, in Arrow batches.
"""

from __future__ import annotations

import difflib
import math
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import text as tx

# Marks that don't belong to a quotation, the shortest quotation in characters, the words from which on it may
# span three sentences, and the similarities that count.
EDGE = " .!?,;:\"'“”‘’"
SHORTEST, LONG = 25, 25
NEAR, NEAR_WITH_WORDS, BLOCK = 0.85, 0.70, 0.70

_ASCII = r"^[\x00-\x7f]*$"
_EDGES = r"^[ .!?,;:\"'“”‘’]+|[ .!?,;:\"'“”‘’]+$"
_PLAIN_MARKS = {0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"', 0x2013: "-", 0x2014: "-"}


def match_form(text: str | None) -> str:
    """Compatibility form with plain quotes and dashes on one line."""
    x = text or ""
    return " ".join((x if x.isascii() else unicodedata.normalize("NFKC", x).translate(_PLAIN_MARKS)).split())


@F.pandas_udf(T.StringType())
def _match_forms(text: pd.Series) -> pd.Series:
    return text.map(match_form, na_action="ignore")


def matching_form(c: Column | str) -> Column:
    """``match_form`` of a column; ASCII text never leaves the JVM. NULL gives ''."""
    x = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    plain = x.rlike(_ASCII)
    return F.when(plain, tx.one_line(x)).otherwise(_match_forms(F.when(~plain, x)))


def shares_block(e: Column, f: Column, least: float = BLOCK) -> Column:
    """Whether ``f`` holds a block of at least the share ``least`` of ``e``: some window of so many characters is in it."""
    need = F.ceil(F.length(e) * F.lit(least) - F.lit(1e-9)).cast("int")
    starts = F.sequence(F.lit(1), F.greatest(F.length(e) - need + 1, F.lit(1)))
    return F.when((e == "") | (f == ""), False).otherwise(F.contains(f, e) | F.exists(starts, lambda i: F.contains(f, F.substr(e, i, need))))


def found_in_source(evidence: Column, title: Column, content: Column, least: float = BLOCK) -> Column:
    """Whether a quotation is in its source word by word, or a block of at least ``least`` of it is; marks and letter case don't count."""
    whole = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")))
    return tx.let(F.struct(tx.word_form(F.coalesce(evidence, F.lit(""))).alias("e"), tx.word_form(whole).alias("f")), lambda x: shares_block(x["e"], x["f"], least))


def in_source(evidence: str | None, title: str | None, content: str | None, least: float = BLOCK) -> bool:
    """``found_in_source`` of plain strings."""
    e, f = (re.sub(r"\W+", " ", x.lower()).strip() for x in (evidence or "", f"{title or ''} {content or ''}"))
    need = math.ceil(len(e) * least - 1e-9)
    return bool(e and f) and any(e[i : i + need] in f for i in range(len(e) - need + 1))


def passages(source: Column, three: Column) -> Column:
    """Each sentence of a text, each two in a row and, where ``three``, each three in a row, in this order."""
    def runs(s: Column) -> Column:
        n = lambda k: F.when(F.size(s) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size(s) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(s, i, k), " "))).otherwise(F.array().cast("array<string>"))
        return F.concat(s, n(2), F.when(three, n(3)).otherwise(F.array().cast("array<string>")))

    return tx.let(tx.sentences(F.coalesce(source, F.lit(""))), runs)


def closest(quote: str, options: list[str], least: float = NEAR) -> str | None:
    """The first of ``options`` that holds the quotation or, if none does, the most similar one; None if it isn't similar enough.

    Similar is what has ``least`` of its characters in common, or most words and ``NEAR_WITH_WORDS`` of the characters. What can't get
    there by its length or its letters is not compared. Of equally similar options the last counts, by words the first.
    """
    core = match_form(quote).strip(EDGE)
    low = core.lower()
    forms = [match_form(o) for o in options]
    bare = [f.strip(EDGE).lower() for f in forms]
    for o, f, b in zip(options, forms, bare):
        if core in f or low in b:
            return o
    own, letters = set(re.findall(r"\w+", low)), Counter(low)
    by_letters, by_words = [], []
    for k, b in enumerate(bare):
        total = len(low) + len(b)
        words = len(own & set(re.findall(r"\w+", b))) / len(own) if own else 0.0
        floor = NEAR_WITH_WORDS if words >= least else least
        if not b or 2 * min(len(low), len(b)) < floor * total or 2 * sum((letters & Counter(b)).values()) < floor * total:
            continue
        ratio = difflib.SequenceMatcher(None, low, b).ratio()
        by_letters.append((ratio, k))
        if words >= least and ratio >= NEAR_WITH_WORDS:
            by_words.append(((words + ratio) / 2, -k))
    best, words = max(by_letters, default=(0.0, 0)), max(by_words, default=(0.0, 0))
    if max(best[0], words[0]) < least:
        return None
    return options[best[1]] if best[0] >= words[0] else options[-words[1]]


def recover(quote: str | None, source: str | None, least: float = NEAR) -> str | None:
    """The passage of ``source`` that ``quote`` quotes, in the source's own words; None if there is none."""
    form = match_form(quote)
    if not source or len(form) < SHORTEST:
        return None
    one = [s for s in (" ".join(x.split()) for x in re.split(r"(?<=[.!?])\s+", source.strip())) if s]
    spans = range(1, 4 if len(form.split()) >= LONG else 3)
    return closest(form, [" ".join(one[i : i + n]) for n in spans for i in range(len(one) - n + 1)], least)


@F.pandas_udf(T.StringType())
def _closest(quote: pd.Series, options: pd.Series) -> pd.Series:
    out = []
    for q, o in zip(quote, options):
        if q is None or len(form := match_form(q)) < SHORTEST:
            out.append(None)
            continue
        if len(form.split()) < LONG and len(o) > 3 and not q.isascii():
            o = o[: 2 * (len(o) // 3) + 1]  # of n sentences there are n, n - 1 and n - 2 passages; the last ones are for long quotations
        out.append(closest(form, list(o)))
    return pd.Series(out, dtype="object")


# kept apart from what filters and projections do with its result
_closest = _closest.asNondeterministic()


def with_recovered(df: DataFrame, quote: str, source: str, out: str) -> DataFrame:
    """``df`` with ``out``, the passage of ``source`` that ``quote`` quotes, in the source's own words; NULL if there is none.

    Quotations of less than ``SHORTEST`` characters quote nothing. What is contained in ASCII text is found by expressions; the rest is compared in
    Python once a row. Blank or NULL quotations and sources give NULL, and rows are neither lost nor doubled.
    """
    raw = F.coalesce(F.col(quote), F.lit(""))
    q, ascii_quote = tx.one_line(raw), raw.rlike(_ASCII)
    some = (F.coalesce(source, F.lit("")) != "") & (~ascii_quote | (F.length(q) >= SHORTEST))
    x = df.withColumn("__options", F.when(some, passages(F.col(source), ~ascii_quote | (F.size(F.split(q, " ")) >= LONG))))
    core = F.regexp_replace(q, _EDGES, "")
    inside = lambda o: F.contains(o, core) | F.contains(F.lower(F.regexp_replace(o, _EDGES, "")), F.lower(core))
    x = x.withColumn("__hit", F.when(ascii_quote & F.col(source).rlike(_ASCII) & F.col("__options").isNotNull(), F.get(F.filter("__options", inside), F.lit(0))))
    left = F.col("__hit").isNull() & F.col("__options").isNotNull()
    x = x.withColumn("__near", _closest(F.when(left, F.col(quote)), F.when(left, F.col("__options"))))
    return x.withColumn(out, F.coalesce("__hit", "__near")).drop("__options", "__hit", "__near")
