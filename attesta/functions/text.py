"""Normalising, splitting and comparing text with built-in functions."""

from __future__ import annotations

import html
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import lexicon as lx

_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it, also inside lambdas and branches."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def blank_to_null(c: Column) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def one_line(c: Column) -> Column:
    """White space collapsed to single blanks."""
    return F.trim(F.regexp_replace(c, f"{_SPACE}+", " "))


def title_form(c: Column) -> Column:
    """Lower case letters a-z and digits, everything else a blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+", " "))


def word_form(c: Column) -> Column:
    """Lower case words of any script, joined by single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def words(c: Column) -> Column:
    """The distinct words of any script in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1))


def latin_terms(c: Column, least: int, pattern: str = "a-z") -> Column:
    """Words made only of ``pattern`` with at least ``least`` characters, in order of occurrence."""
    every = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}\p{M}_]+)"), 1)
    return F.filter(every, lambda w: w.rlike(f"^[{pattern}]{{{least},}}$"))


def keywords(claim: Column) -> Column:
    """The distinct content words of a claim."""
    return F.array_distinct(F.array_except(latin_terms(claim, 3), F.array(*map(F.lit, lx.CLAIM_STOP_WORDS))))


def topic_words(topic: Column, stop: Sequence[str]) -> Column:
    every = F.regexp_extract_all(F.lower(topic), F.lit("([a-z0-9]{3,})"), 1)
    return F.array_distinct(F.array_except(every, F.array(*map(F.lit, stop))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements of two arrays over all their elements; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def sentences(c: Column) -> Column:
    """Sentences split after . ! ? and white space of any kind, collapsed to one line, without empty ones."""
    return F.filter(F.transform(F.split(strip(c), f"(?<=[.!?]){_SPACE}+"), one_line), lambda s: s != "")


#: Stands for a dot that ends no sentence while text is split; a private-use character no text contains.
_DOT = "\ue000"


def windows(c: Column, size: int = 2) -> Column:
    """Overlapping windows of ``size`` sentences; usual abbreviations end no sentence. One window if there are no more sentences."""
    if size < 1:
        raise ValueError("a window has at least one sentence")
    kept = strip(c)
    for pattern in (r"(?i)\b(e)\.(g)\.", r"(?i)\b(i)\.(e)\."):
        kept = F.regexp_replace(kept, pattern, f"$1{_DOT}$2{_DOT}")
    kept = F.regexp_replace(kept, r"(?i)\b(figs?|eqs?|refs?)\.", f"$1{_DOT}")
    parts = F.filter(F.transform(F.split(kept, f"(?<=[.!?]){_SPACE}+"), lambda s: F.replace(strip(s), F.lit(_DOT), F.lit("."))), lambda s: s != "")

    def slide(p: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(p) - size + 1), lambda i: F.array_join(F.slice(p, i, size), " "))
        return F.when(F.size(p) == 0, F.array().cast("array<string>")).when(F.size(p) <= size, F.array(F.array_join(p, " "))).otherwise(many)

    return let(parts, slide)


def authors_line(authors: Column) -> Column:
    """Up to three names and ``et al.``; ``N/A`` if there is none."""
    names = F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda n: n.isNotNull() & (n != ""))
    line = F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.when(F.size(names) > 3, F.lit(" et al.")).otherwise(F.lit("")))
    return F.when(F.size(names) == 0, F.lit("N/A")).otherwise(F.trim(F.translate(line, "|\n", "/ ")))


@F.pandas_udf(T.StringType())
def _unescaped(c: pd.Series) -> pd.Series:
    return c.map(lambda x: html.unescape(html.unescape(x)), na_action="ignore")


def unescaped(c: Column) -> Column:
    """Without character references, also those that were written as such twice; text without ``&`` never leaves the JVM."""
    marked = F.contains(c, F.lit("&"))
    return F.when(marked, _unescaped(F.when(marked, c))).otherwise(c)


def cell(c: Column, limit: int) -> Column:
    """A table cell: no character references, bars or line breaks, cut at a word with an ellipsis."""
    return cut_cell(unescaped(c), limit)


def cut_cell(c: Column, limit: int) -> Column:
    """``cell`` of text without character references, also inside lambdas."""
    return let(
        strip(F.translate(c, "|\n", "/ ")),
        lambda t: F.when(F.length(t) > limit, F.concat(F.regexp_replace(F.substring(t, 1, limit), r" [^ ]*$", ""), F.lit("…"))).otherwise(t),
    )


def clean_query(c: Column, most: int = 7) -> Column:
    """A search query without prefixes, quotes, operators and brackets, of at most ``most`` terms."""
    q = strip(c)
    for prefix in ("QUERY:", "Query:", "SEARCH QUERY:", "Search query:", "Search:", "GAP:"):
        q = F.when(F.startswith(q, F.lit(prefix)), strip(F.substring(q, len(prefix) + 1, 1_000_000))).otherwise(q)
    q = F.regexp_replace(q, "^[\"'`]+|[\"'`]+$", "")
    q = F.regexp_replace(F.regexp_replace(q, r"\b(AND|OR|NOT)\b", " "), r"[()\[\]{}:;?,\n\r]", " ")

    def shorten(terms: Column) -> Column:
        kept = F.filter(terms, lambda w: ~F.lower(w).isin(lx.QUERY_STOP_WORDS))
        return F.array_join(F.when(F.size(terms) <= most, terms).otherwise(F.slice(F.when(F.size(kept) >= 3, kept).otherwise(terms), 1, most)), " ")

    return let(F.split(one_line(q), " "), shorten)


def key_passages(c: Column, most: int = 12, chars: int = 3500) -> Column:
    """The sentences most likely to state findings, in their order."""
    text = F.regexp_replace(F.split(c, r"(?i)\n#+\s*(?:references|bibliography)\b", 2)[0], r"\s+", " ")
    parts = F.split(text, r"(?<=[.!?])\s+")
    scored = F.transform(parts, lambda s, i: F.struct((-F.regexp_count(s, F.lit("(?i)" + lx.FINDING_CUES))).alias("n"), i.alias("i"), s.alias("s")))
    scored = F.slice(F.array_sort(F.filter(scored, lambda x: (F.length(x["s"]) > 40) & (F.length(x["s"]) < 400))), 1, most)
    chosen = let(scored, lambda x: let(F.filter(x, lambda v: v["n"] < 0), lambda cued: F.when(F.size(cued) > 0, cued).otherwise(x)))
    ordered = F.array_sort(F.transform(chosen, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
    return F.substring(F.array_join(F.transform(ordered, lambda x: x["s"]), " "), 1, chars)


def from_inverted_index(index: Column) -> Column:
    """Text of a map from words to their positions; of two words at one position the last in the map stays."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e, k: F.transform(e["value"], lambda p: F.struct(p.alias("p"), (-k).alias("k"), e["key"].alias("w")))))
    first = let(F.array_sort(pairs), lambda o: F.filter(o, lambda x, i: (i == 0) | (x["p"] != F.get(o, i - 1)["p"])))
    return F.array_join(F.transform(first, lambda x: x["w"]), " ")
