"""Texts that were read in the wrong character encoding.

Learning. Words and sentences are reduced to their ASCII characters. Pieces with equal remains are near-twins; the
most frequent form of a remain is taken as clean and aligned with every other form, run of non-ASCII characters by
run. A pair of codecs (written as one, read as the other) that turns the clean runs into the garbled ones of enough
distinct twins is learned, and so is each pair of runs it explains. Runs that end up as nothing but ``?`` or U+FFFD teach that
this mark stands for lost characters.

Applying. Sequences that a learned pair reads back as valid UTF-8 are replaced, again until none is left (text may be
garbled twice). A learned pair of one-byte codecs maps characters to characters, so the distinct words of the corpus are mapped
by ``translate`` and joined with themselves: a word is garbled if what it reads back as is much more frequent. Words with lost
characters are replaced by their clean twin. Sequences that stand alone in a context in which no clean text occurs are quoted as a
subject and are left as they are. Only texts with a learned sequence, a garbled word or a lost mark go through Python again.

Defined cases
    NULL and empty texts are never damaged. A table without twins learns nothing and reports U+FFFD only, which by
    definition stands for bytes that could not be read. Texts are read whole. Repeated rows are each reported.

Bounds
    What goes to all executors is bounded by characters and codecs, not by rows: the learned pairs of codecs, the pairs of a
    sequence and the one character it stands for, and the letters in use. Words and contexts are joined, never sent.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.durable import durable
from attesta.operators.skew import hot_keys, salted_lookup
from attesta.operators.spread import spread

# Codecs that occur in the wild, as what a text was written in and what it was read as.
WRITTEN = ("utf-8", "cp1251", "koi8-r", "iso8859-2", "cp1250", "cp1252", "cp866", "mac_cyrillic")
READ = ("cp1252", "cp1251", "cp1250", "iso8859-2", "cp437", "cp850", "cp866", "mac_roman", "koi8-r", "iso8859-5", "iso8859-15")

#: A pair of codecs is learned from at least this many distinct aligned pairs of runs.
LEAST_TWINS = 3
#: Letters and contexts count as in use if so many distinct texts have them.
LEAST_TEXTS = 4
#: Distinct texts that need the word read back for each one that has the garbled word, and besides.
MORE = 4
#: A stand-alone garbled word needs so many.
MUCH_MORE = 20

# Fixed value: what stands for characters that had no place in the other encoding, a question mark inside a word or U+FFFD.
_LOST_RUN = r"(?<=[A-Za-z])\?(?=[a-z])"

_RUN = re.compile(r"[^\x00-\x7f]+|" + _LOST_RUN)
_ONE = re.compile(r"[^\x00-\x7f]")
_HIGH_RUN = re.compile(r"[^\x00-\x7f]+")
# other blanks may be part of a garbled character
_TOKEN = re.compile(r"[^ \t\n\r\f\v]+")
_DIGITS = re.compile(r"[0-9]+([.,][0-9]+)*")
_LATIN = re.compile(r"[A-Za-z]+")
_LOST = "�"
LOST = "lost"


def _high(codec: str) -> dict[int, str]:
    """Byte to character above ASCII; bytes a codec leaves undefined are read as control characters, as browsers do."""
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


class Codec:
    """Reading back: the characters ``read`` gives for bytes, turned into bytes again."""

    def __init__(self, read: str):
        high = _high(read)
        self.byte = {c: b for b, c in high.items()}
        if read == "cp1252":
            self.byte |= {chr(b): b for b in range(128, 160)}
        cls = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in self.byte.items() if lo <= b <= hi) + "]"
        tail = cls(0x80, 0xBF)
        pattern = f"{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xF0, 0xF4)}{tail}{{3}}"
        self.sequence = re.compile(pattern)

    def bytes_of(self, s: str) -> bytes | None:
        try:
            return bytes(self.byte[c] if ord(c) > 127 else ord(c) for c in s)
        except KeyError:
            return None


_CODECS: dict[str, Codec] = {}


def codec(read: str) -> Codec:
    if read not in _CODECS:
        _CODECS[read] = Codec(read)
    return _CODECS[read]


def back(s: str, written: str, read: str) -> str | None:
    """``s`` as it was before it was written in one codec and read in the other; None if that can't have happened."""
    b = codec(read).bytes_of(s)
    if b is None:
        return None
    try:
        return b.decode(written)
    except UnicodeDecodeError:
        return None


def aligned(clean: str, garbled: str) -> list[tuple[str, str]]:
    """The runs of non-ASCII characters of two texts with the same ASCII remains, side by side; [] if they don't align."""
    a, b = _RUN.split(clean), _RUN.split(garbled)
    if a == b:
        return [(x, y) for x, y in zip(_RUN.findall(clean), _RUN.findall(garbled)) if x != y]
    return []


@lru_cache(maxsize=100_000)
def explained(clean: str, garbled: str) -> list[tuple[str, str]]:
    """The codec pairs that turn the one run into the other; ``lost`` and the mark if the garbled run is nothing but a mark."""
    if garbled[0] in "?�" and not garbled.strip(garbled[0]):
        return [] if clean[0] in "?�" else [(LOST, garbled[0])]
    return [(w, r) for w in WRITTEN for r in READ if w != r and back(garbled, w, r) == clean]


def _read_as(c: str, written: str, read: str) -> str:
    high = _HIGH.setdefault(read, _high(read))
    return "".join(high.get(b, chr(b)) for b in c.encode(written))


_HIGH: dict[str, dict[int, str]] = {}


@dataclass
class Learned:
    """What applies to the whole corpus."""

    pairs: list[tuple[str, str]]
    runs: set[tuple[str, str]] = field(default_factory=set)
    letters: set[str] = field(default_factory=set)

    @property
    def reads(self) -> list[str]:
        """What UTF-8 was read as."""
        return [r for w, r in self.pairs if w == "utf-8"]

    @property
    def single(self) -> list[tuple[str, str]]:
        """The pairs of one-byte codecs."""
        return [p for p in self.pairs if p[0] not in ("utf-8", LOST)]

    @property
    def marks(self) -> set[str]:
        """What stands for lost characters."""
        return {_LOST} | {r for w, r in self.pairs if w == LOST}

    @property
    def controls(self) -> bool:
        """Whether a learned reading leaves control characters."""
        return any(_UPPER_CONTROL.search(g) for g, _ in self.runs)


@dataclass
class Near:
    """What the corpus says of the words of one text: the garbled ones by pair of codecs, those with lost characters, the usual ones, and the contexts that quote."""

    garbled: dict[tuple[str, int], bool] = field(default_factory=dict)
    lost: dict[str, str] = field(default_factory=dict)
    usual: set[str] = field(default_factory=set)
    quoted: set[str] = field(default_factory=set)


_EDGE = "“”„‟‘’‚\"'«»‹›()[]{}.,;:!?…、。"
_ASCII_LEFT = re.compile(r"[^A-Za-z]")


def _plain(w: str) -> str:
    return _ASCII_LEFT.sub("", w).lower()


def _tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def _alone(text: str, spans: list[tuple[int, int]], i: int) -> bool:
    t = text[spans[i][0] : spans[i][1]].strip('“”"\'.,;:()[]')
    return bool(t) and not any(c.isascii() for c in t)


def context(text: str, spans: list[tuple[int, int]], i: int) -> str:
    """The words around a token, as their ASCII letters."""
    before = _plain(text[slice(*spans[i - 1])]) if i else ""
    after = _plain(text[slice(*spans[i + 1])]) if i + 1 < len(spans) else ""
    return before + "|" + after


def _sequences(text: str, read: str, letters: set[str] | None) -> list[tuple[int, int, str]]:
    out = []
    c = codec(read)
    for m in c.sequence.finditer(text):
        try:
            ch = c.bytes_of(m.group()).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if letters is None or ch in letters:
            out.append((m.start(), m.end(), ch))
    return out


_CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5")
_UPPER_CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
_EAST_ASIAN = re.compile("[\u3040-\u30ff\u4e00-\u9fff]")


def _double_byte(text: str) -> str:
    """A text in a two-byte Japanese encoding, read back whole; others as they are."""
    for w in ("shift_jis", "euc_jp"):
        c = back(text, w, "cp1252")
        if c and len(_EAST_ASIAN.findall(c)) * 3 > len(c):
            return c
    return text


def restore(text: str, known: Learned, near: Near | None = None) -> tuple[str, bool]:
    """The text as far as it can be regained, and whether it was damaged at all."""
    near = near or Near()
    damaged = "?" in known.marks and _questioned(text)
    if near.lost:
        text = " ".join(_word_for_lost(t, near.lost) for t in text.split(" "))
    if text.isascii():
        return text, damaged
    if known.controls and _UPPER_CONTROL.search(text):
        damaged = True
        text = _double_byte(text)
    for _ in range(3):
        spans = _tokens(text)
        starts = [s for s, _ in spans]
        best: tuple[int, str, list] = (0, "", [])
        for r in known.reads:
            found = _sequences(text, r, known.letters)
            if not found:
                continue
            found = _unquoted(text, spans, starts, found, near)
            joined = sum(1 for a, b in zip(found, found[1:]) if a[1] == b[0])
            trusted = sum((text[s:e], ch) in known.runs for s, e, ch in found)
            if not found:
                continue
            score = sum(e - s for s, e, _ in found)
            around = sum(ord(c) > 127 for c in text[found[0][0] : found[-1][1]])
            if score > best[0] and score * 2 >= around and (trusted > (joined == 0) or joined > 1 or (trusted and r not in _CYRILLIC)):
                best = (score, r, found)
        if not best[0]:
            break
        damaged, out, at = True, [], 0
        for s, e, ch in best[2]:
            out += [text[at:s], ch]
            at = e
        text = "".join([*out, text[at:]])
    spans = _tokens(text)
    for k, (w, r) in enumerate(known.single) if near.garbled else ():
        hits = []
        for i, (s, e) in enumerate(spans):
            g = text[s:e].strip(_EDGE)
            if g and (g, k) in near.garbled:
                hits.append((i, len(g), near.garbled[g, k]))
        if len(hits) >= 2 or (len(hits) == 1 and hits[0][1] >= 4 and hits[0][2]):
            damaged = True
            first, last = hits[0][0], hits[-1][0]
            pieces, at = [], 0
            sure = {h[0] for h in hits}
            for i in range(first, last + 1):
                s, e = spans[i]
                g = text[s:e]
                c = back(g, w, r) if not g.isascii() else None
                if c is not None and (i in sure or g.strip(_EDGE) not in near.usual):
                    pieces += [text[at:s], c]
                    at = e
            text = "".join([*pieces, text[at:]])
            spans = _tokens(text)
    if _LOST in text:
        starts = [s for s, _ in spans]
        lost = [(m.start(), m.end(), _LOST) for m in re.finditer(_LOST, text)]
        damaged = damaged or bool(_unquoted(text, spans, starts, lost, near))
    return text, damaged or bool(near.lost)


def _word_for_lost(token: str, lost: dict[str, str]) -> str:
    g = token.strip(_EDGE)
    return token.replace(g, lost[g]) if g and g in lost else token


def _questioned(text: str) -> bool:
    """A question mark inside a word, where a character had no place in the other encoding."""
    return any("/" not in t and "=" not in t and t.count("?") <= 2 for t in re.findall(r"\S*[A-Za-z]\?[a-z]\S*", text)) if "?" in text else False


def _unquoted(text: str, spans: list, starts: list, found: list, near: Near) -> list:
    if not near.quoted:
        return found
    out = []
    for s, e, ch in found:
        i = bisect_right(starts, s) - 1
        if _alone(text, spans, i) and context(text, spans, i) in near.quoted:
            continue
        out.append((s, e, ch))
    return out


_PIECES = "t bigint, kind string, left string, piece string, n bigint"


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct pieces with non-ASCII characters, each with its text or with its number of texts.

    Kinds: w, words, one row a text; x, tokens without any ASCII character between words that have some, one row a text, whose ``left`` is the words around them; s, sentences mostly of
    non-ASCII characters; t, these sentences without their numbers and names, where ``left`` keeps the places of the characters taken out; u, the same with one place for each run.
    """
    for pdf in batches:
        n: Counter = Counter()
        rows = []
        for t, text in zip(pdf["t"], pdf["text"]):
            words, tokens = set(), _TOKEN.findall(text)
            for i, token in enumerate(tokens):
                if token.isascii() and not ("?" in token and _RUN.search(token)):
                    continue
                g = token.strip(_EDGE)
                if not g:
                    continue
                words.add(("w", None, g))
                at = token.find(g)
                if (not g[-1].isascii() and not token[at + len(g) : at + len(g) + 1].isascii()) or (not g[0].isascii() and not token[max(0, at - 1) : at].isascii()):
                    words.add(("w", None, token))  # the mark may be part of a garbled character
                if not any(c.isascii() for c in g):
                    around = _plain(tokens[i - 1] if i else "") + "|" + _plain(tokens[i + 1] if i + 1 < len(tokens) else "")
                    if len(around) > 1:
                        words.add(("x", around, g))
            rows += [(t, *w, 1) for w in words]
            if len(text.encode("utf-8", "surrogatepass")) * 3 > len(text) * 4:
                seen = set()
                for s in re.split(r"(?<=[.!?。])\s+|\n+", text):
                    if sum(ord(c) > 127 for c in s) * 2 > len(s):
                        bare = _LATIN.sub("X", _DIGITS.sub("9", s))
                        seen |= {("s", _HIGH_RUN.sub("", s), s), ("t", _ONE.sub("□", bare), bare), ("u", _HIGH_RUN.sub("□", bare), bare)}
                n.update(seen)
        rows += [(None, *k, c) for k, c in n.items()]
        ts = pd.array([r[0] for r in rows], dtype="Int64")  # never by way of floats
        yield pd.DataFrame({"t": ts, **{c: pd.Series([r[i] for r in rows], dtype="object") for i, c in ((1, "kind"), (2, "left"), (3, "piece"))}, "n": [r[4] for r in rows]}).astype({"n": "int64"})


def _twins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        n: Counter = Counter()
        for clean, garbled, tie in zip(pdf["clean"], pdf["piece"], pdf["tie"]):
            for a, b in aligned(clean, garbled):
                for x, y in ((a, b), (b, a)) if tie else ((a, b),):
                    for w, r in explained(x, y):
                        for c in x if w == "utf-8" else (x,):
                            n[w, r, _read_as(c, w, r) if w == "utf-8" else y, c] += 1
        yield pd.DataFrame([(*k, c) for k, c in n.items()], columns=["written", "read", "garbled", "clean", "n"]).astype({"n": "int64"})


def _texts(docs: DataFrame) -> DataFrame:
    """``(t, text, n)``: each distinct text that has more than ASCII characters or a question mark inside a word."""
    some = docs.select("text").where(F.col("text").rlike(r"[^\x00-\x7f]|[A-Za-z]\?[a-z]"))
    return some.groupBy(F.xxhash64("text").alias("t")).agg(F.first("text").alias("text"), F.count("*").alias("n"))


def _found(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct texts of ``docs``, their pieces by text, and the distinct pieces with their number of texts."""
    texts = durable(_texts(docs))
    rows = durable(spread(texts.select("t", "text")).mapInPandas(_pieces, _PIECES))
    left = F.when(F.col("kind") == "w", F.regexp_replace("piece", r"[^\x00-\x7f]+|" + _LOST_RUN, "")).otherwise(F.col("left"))
    each = durable(rows.groupBy("kind", "left", "piece").agg(F.sum("n").alias("n")).withColumn("left", left))
    return texts, rows, each


def _clean_twins(each: DataFrame) -> DataFrame:
    """``(kind, piece, n, clean, most)``: each piece beside the most frequent one with the same remains."""
    letters_left = F.length(F.regexp_replace("left", "[^A-Za-z0-9]", ""))
    least = F.when(F.col("kind") == "w", 1).when(F.col("kind") == "x", 4).otherwise(6)
    usable = each.where(F.when(F.col("kind") == "t", F.length("left") >= 20).when(F.col("kind") == "u", F.length("left") >= 8).otherwise(letters_left >= least))
    clean = usable.groupBy("kind", "left").agg(F.max_by("piece", F.struct("n", F.negative(F.length("piece")), "piece")).alias("clean"), F.max("n").alias("most"), F.count("*").alias("forms")).where("forms > 1")
    return usable.join(clean, ["kind", "left"]).where("piece <> clean").select("kind", "piece", "n", "clean", "most")


def learn(docs: DataFrame) -> Learned:
    """What the twins of ``docs`` (``text``) teach about the whole corpus. Exact copies of a text teach once."""
    each = _found(docs)[2]
    return _learn(each, _clean_twins(each))


def _learn(each: DataFrame, twins: DataFrame) -> Learned:
    runs = durable(
        twins.select("clean", "piece", F.expr("n = most").alias("tie")).mapInPandas(_twins, "written string, read string, garbled string, clean string, n bigint")
        .groupBy("written", "read", "garbled", "clean").agg(F.sum("n").alias("n"))
    )
    pairs = [
        (r["written"], r["read"])
        for r in runs.groupBy("written", "read").agg(F.count("*").alias("k"), F.sum("n").alias("n")).where(F.col("k") >= LEAST_TWINS).orderBy(F.desc("n"), "written", "read").collect()
    ]
    top = runs.where((F.col("written") == "utf-8") & (F.length("clean") == 1)).select("garbled", "clean").distinct()
    known = Learned(pairs, {(r[0], r[1]) for r in top.collect()})
    one = each.where("kind = 'w'").select(F.explode(F.array_distinct(F.split("piece", ""))).alias("c"), "n").where("c > '\u007f'")
    letters = {c for c, in one.groupBy("c").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS).select("c").collect()}
    known.letters = {c for c in letters if len(c) == 1 and ord(c) > 159 and c != _LOST} | {c.upper() for c in letters if len(c.upper()) == 1 and ord(c) > 159} | {x for _, x in known.runs}
    known.letters |= set(_EDGE) - {c for c in _EDGE if ord(c) < 128} | {" "}
    return known


def _mapped(word: Column, written: str, read: str) -> Column:
    """A word read back by a pair of one-byte codecs, character by character; NULL if it can't have been read so."""
    table = {}
    for c, b in codec(read).byte.items():
        try:
            table[c] = bytes([b]).decode(written)
        except UnicodeDecodeError:
            pass
    table = {c: x for c, x in table.items() if len(c) == len(x) == 1}
    able = F.translate(word, "".join(table), "").rlike(r"^[\x00-\x7f]*$")
    return F.when(able, F.translate(word, "".join(table), "".join(table.values())))


def _garbled_words(words: DataFrame, known: Learned) -> DataFrame:
    """``(word, hits)``: the distinct ``words`` (``word, n``) that a learned pair of one-byte codecs reads back as a much more frequent one."""
    usual = durable(words.groupBy(F.lower("word").alias("low")).agg(F.sum("n").alias("n")))
    forms = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _mapped(F.col("word"), w, r).alias("c")) for k, (w, r) in enumerate(known.single)]))
    tried = words.select("word", F.lower("word").alias("low"), forms.alias("f")).where("f.c IS NOT NULL AND f.c <> word").select("word", "low", F.col("f.k").alias("k"), F.lower("f.c").alias("c"))
    both = tried.join(usual.select(F.col("low").alias("c"), F.col("n").alias("much")), "c").join(usual.select("low", F.col("n").alias("few")), "low")
    both = both.withColumn("few", F.when(F.col("few") >= LEAST_TEXTS, F.col("few")).otherwise(0))
    hits = both.where(F.col("much") >= MORE * (F.col("few") + 1))
    return hits.groupBy("word").agg(F.collect_list(F.struct("k", (F.col("much") >= MUCH_MORE * (F.col("few") + 1)).alias("sure"))).alias("hits"))


def _with_sequences(words: DataFrame, known: Learned) -> DataFrame:
    """``(word, bad)`` of the distinct ``words`` that hold a sequence which a learned reading of UTF-8 leaves (``bad`` 1) or could leave (0), or a mark or control character (1)."""
    reads, letters, marks, controls = [*dict.fromkeys([*known.reads, "cp1252"])], known.letters, known.marks, known.controls

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for w in pdf["word"]:
                if _LOST in w or ("?" in marks and "?" in w and _RUN.search(w)) or (controls and _UPPER_CONTROL.search(w)) or any(_sequences(w, r, letters) for r in reads):
                    rows.append((w, 1))
                elif any(_sequences(w, r, None) for r in reads):
                    rows.append((w, 0))
            yield pd.DataFrame(rows, columns=["word", "bad"]).astype({"bad": "int32"})

    return words.select("word").mapInPandas(run, "word string, bad int")


def _quoting(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """``(left)``: the contexts between two words in which damaged characters stand alone and clean ones hardly ever do."""
    mine = rows.where("kind = 'x' AND NOT startswith(left, '|') AND NOT endswith(left, '|')").groupBy("left", "piece").agg(F.sum("n").alias("n"))
    mine = mine.join(seen.select(F.col("word").alias("piece"), F.lit(True).alias("bad")), "piece", "left")
    sums = mine.groupBy("left").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("good"))
    return sums.where((F.col("bad") >= LEAST_TEXTS) & (F.col("good") * 20 < F.col("bad"))).select("left")


def restored(docs: DataFrame, id_col: str = "doc_id", known: Learned | None = None) -> DataFrame:
    """``(id, restored)`` for each damaged text: what it said, as far as it can be regained."""
    texts, rows, each = _found(docs)
    twins = durable(_clean_twins(each))
    known = known or _learn(each, twins)
    words = each.where("kind = 'w'").select(F.col("piece").alias("word"), "n")
    tokens = rows.where("kind = 'w'").select("t", F.col("piece").alias("word"))
    schema = "word string, hits array<struct<k:int,sure:boolean>>"
    garbled = durable(_garbled_words(words, known)) if known.single else docs.sparkSession.createDataFrame([], schema)
    marks = "[" + "".join("\\" + m for m in sorted(known.marks)) + "]"
    lost = twins.where((F.col("kind") == "w") & F.col("piece").rlike(marks) & ~F.col("clean").rlike(marks) & (F.col("most") >= LEAST_TEXTS) & (F.length(F.regexp_replace("piece", "[^A-Za-z]", "")) >= 3))
    lost = lost.select(F.col("piece").alias("word"), F.col("clean").alias("lost")).where("length(word) = length(lost)")
    seen = durable(_with_sequences(words, known))
    # the words that tell something, and the texts they are in
    telling = garbled.join(lost, "word", "full").join(seen.where("bad = 1"), "word", "full").select("word", "hits", "lost")
    told = salted_lookup(tokens, telling, "word", hot_keys(words, "word"), "t")
    told = durable(told.groupBy("t").agg(F.collect_list(F.struct("word", "hits", "lost")).alias("told")))
    ours = told.select("t")
    usual = tokens.join(ours, "t", "left_semi").join(words.where(F.col("n") >= LEAST_TEXTS).select("word"), "word", "left_semi").groupBy("t").agg(F.collect_list("word").alias("usual"))
    quoted = rows.where("kind = 'x'").select("t", "left").join(ours, "t", "left_semi").join(_quoting(rows, seen), "left", "left_semi").groupBy("t").agg(F.collect_set("left").alias("quoted"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, text, told, usual, quoted in zip(pdf["t"], pdf["text"], pdf["told"], pdf["usual"], pdf["quoted"]):
                near = Near(usual=set(usual if usual is not None else ()), quoted=set(quoted if quoted is not None else ()))
                for x in told if told is not None else ():
                    if x["lost"] is not None:
                        near.lost[x["word"]] = x["lost"]
                    for h in x["hits"] if x["hits"] is not None else ():
                        near.garbled[x["word"], h["k"]] = h["sure"]
                done, bad = restore(text, known, near)
                if bad:
                    out.append((t, done))
            yield pd.DataFrame(out, columns=["t", "restored"]).astype({"t": "int64"})

    whole = texts.join(told, "t").join(usual, "t", "left").join(quoted, "t", "left").select("t", "text", "told", "usual", "quoted")
    done = durable(spread(whole).mapInPandas(run, "t bigint, restored string"))
    keyed = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.xxhash64("text").alias("t")).where(F.col("text").isNotNull())
    return salted_lookup(keyed, done, "t", hot_keys(texts, "t"), id_col).select(id_col, "restored")
