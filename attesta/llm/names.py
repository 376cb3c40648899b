"""Variant spellings of names, linked to the reference entities they mean.

Distinct spellings and reference names become vectors of character n-grams (taken inside words, so the order of the
parts does not count) weighted by inverse document frequency. A sparse top-n cosine join finds the candidates of each
spelling above a threshold. An exact check of the parts of the name then keeps a candidate only if the spelling can mean it
(edit distance, initials, abbreviations, nicknames, order of parts), and of these only the ones within ``MARGIN`` of the best.
Spellings with one such candidate form the groups of the entities. All others go to the group they have the largest average linkage
with, the mean of their similarities to all its members, and to none if two groups are equally near or all below a
floor. The mean is taken against the sum of the members' vectors, so no group is held in one place.

Defined cases
    NULL, empty and blank names, and names without letters, mean nobody. Repeated rows and slots are each linked. An
    empty reference links nothing. A spelling equal to the reference name is linked by ``link`` with ``exact`` true.
    Very long names are compared whole.

Bounds
    The reference side is sent to all executors only up to ``REFERENCE_ROWS`` rows, which is checked; larger ones
    are joined over their n-grams (``candidates_joined``), with the same result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators.durable import durable
from attesta.operators.skew import hot_keys, salted_lookup

#: Candidates are kept down to this cosine; the nearest TOP_N and all that tie with the last of them.
THRESHOLD = {"author": 0.3, "journal": 0.25}
TOP_N = 24
#: Mean similarity to its group that a spelling needs.
LINKAGE = 0.15
#: Candidates are left to the linkage if the exact check finds them worse than the best by no more than this.
MARGIN = 0.5
REFERENCE_ROWS = 200_000

# Short forms of given names.
NICKNAMES = {
    "alex": "alexander", "sandy": "alexander", "sasha": "alexander", "xander": "alexander", "tony": "anthony", "bea": "beatriz", "trixie": "beatriz", "ben": "benjamin",
    "benny": "benjamin", "benji": "benjamin", "charlie": "charles", "chuck": "charles", "chas": "charles", "chris": "christopher", "kit": "christopher", "topher": "christopher",
    "dan": "daniel", "danny": "daniel", "dima": "dmitri", "mitya": "dmitri", "ed": "edward", "eddie": "edward", "ned": "edward", "ted": "edward theodore", "teddy": "edward theodore",
    "katya": "ekaterina", "katja": "ekaterina", "liz": "elizabeth", "beth": "elizabeth", "eliza": "elizabeth", "betty": "elizabeth", "lisa": "elizabeth", "lizzie": "elizabeth", "libby": "elizabeth",
    "paco": "francisco", "pancho": "francisco", "curro": "francisco", "kiko": "francisco", "fred": "frederick", "freddie": "frederick", "freddy": "frederick", "rick": "frederick richard",
    "beppe": "giuseppe", "peppe": "giuseppe", "pino": "giuseppe", "jim": "james", "jimmy": "james", "jamie": "james", "jen": "jennifer", "jenny": "jennifer", "jenn": "jennifer",
    "hans": "johannes", "jan": "johannes", "joe": "joseph", "joey": "joseph", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine", "kitty": "katherine",
    "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "marge": "margaret", "greta": "margaret", "rita": "margaret", "mike": "michael", "mick": "michael", "mickey": "michael",
    "nick": "nicholas", "nicky": "nicholas", "nico": "nicholas", "pat": "patricia", "patty": "patricia", "tricia": "patricia", "trish": "patricia", "becky": "rebecca", "becca": "rebecca", "bec": "rebecca",
    "dick": "richard", "rich": "richard", "richie": "richard", "bob": "robert", "rob": "robert", "bobby": "robert", "robbie": "robert", "bert": "robert", "sam": "samuel", "sammy": "samuel",
    "sue": "susan", "susie": "susan", "suzy": "susan", "theo": "theodore", "tom": "thomas", "tommy": "thomas", "bill": "william", "will": "william", "billy": "william", "willy": "william", "liam": "william",
    "sofia": "zofia", "zosia": "zofia", "val": "valentina", "ollie": "oluwaseun", "seun": "oluwaseun", "rosa": "rosalia", "xio": "xiomara", "steve": "steven stephen", "andy": "andrew", "drew": "andrew",
    "greg": "gregory", "jeff": "jeffrey", "jerry": "gerald jeremy", "larry": "lawrence", "matt": "matthew", "max": "maximilian", "phil": "philip", "ron": "ronald", "vicky": "victoria", "abby": "abigail",
    "ally": "alison", "cathy": "catherine", "dave": "david", "debbie": "deborah", "don": "donald", "gabe": "gabriel", "hank": "henry", "harry": "henry harold", "jack": "john", "ken": "kenneth",
    "mandy": "amanda", "nate": "nathaniel", "pete": "peter", "ray": "raymond", "tim": "timothy", "toni": "antonia", "walt": "walter", "zach": "zachary", "pepe": "jose", "lola": "dolores", "manolo": "manuel",
}
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "sir", "phd", "md", "msc", "bsc", "jr", "sr", "dphil", "mph"}
PARTICLES = {"van", "von", "de", "del", "della", "di", "da", "la", "le", "den", "der", "al", "el", "bin", "ibn", "ter", "ten", "af", "zu"}
# Short forms of title words that would also fit another word, or that are no beginning of theirs.
SHORT = {"comp": "comparative", "comput": "computational", "intl": "international", "int": "international", "integr": "integrative", "elect": "electronic"}
SMALL_WORDS = {"of", "on", "in", "the", "for", "and", "a", "an", "&"}


def fold(s: str) -> str:
    """Lower case without accents; letters that have no accent of their own by their usual spelling."""
    if s.isascii():
        return s.lower()
    s = s.translate({0xF8: "o", 0xD8: "o", 0x142: "l", 0x141: "l", 0xDF: "ss", 0x131: "i", 0xE6: "ae", 0xC6: "ae", 0x111: "d", 0x110: "d", 0x2019: "'"})
    return "".join([c for c in unicodedata.normalize("NFKD", s) if c < "\u0300" or not unicodedata.combining(c)]).lower()


_REMARKS = re.compile(r"\([^)]*\)|\[[^\]]*\]|[*†‡§¶0-9]")
_DEGREES = re.compile(r"\b(?:ph\.?\s?d|m\.\s?d|m\.?sc|b\.?sc|d\.?phil)\b\.?")
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1024)
def person_form(name: str) -> str:
    """A person's name without titles, degrees, marks and remarks."""
    s = fold(_REMARKS.sub(" ", name))
    if "ph" in s or "sc" in s or "m." in s:
        s = _DEGREES.sub(" ", s)
    return " ".join(s.split()).strip(" ,;")


_EDITIONS = re.compile(r"\((?:online|print|electronic|internet)[^)]*\)|\[[^\]]*edition\]|\s-\s*(?:elect|electronic|online|print)\.?\s*(?:ed|edition)?\.?\s*$", re.I)


@lru_cache(maxsize=1024)
def journal_form(name: str) -> str:
    return re.sub(r"\s+", " ", fold(_EDITIONS.sub(" ", name))).strip(" ,;")


def grams(form: str, n: int = 3) -> Counter:
    words = [f"^{w}$" for w in _WORD.findall(form)]
    return Counter([w[i : i + n] for w in words for i in range(max(1, len(w) - n + 1))])


def letters(s: str) -> int:
    """The letters of a word as bits, of which letters may share one: each edit changes two at most."""
    out = 0
    for c in s:
        out |= 1 << (ord(c) & 63)
    return out


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between two words; ``most + 1`` if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:
        return most + 1
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) or len(b), most + 1)
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            now[j] = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                now[j] = min(now[j], before[j - 2] + 1)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return min(row[-1], most + 1)


@dataclass(frozen=True)
class Person:
    given: str
    middle: str
    surname: str
    words: int = field(init=False, compare=False)
    length: int = field(init=False, compare=False)
    letters: int = field(init=False, compare=False)

    def __post_init__(self) -> None:
        for k, v in (("words", self.surname.count(" ") + 1), ("length", len(self.surname)), ("letters", letters(self.surname))):
            object.__setattr__(self, k, v)


def person(full_name: str) -> Person:
    """A reference name: given name, initials, surname with its particles."""
    w = person_form(full_name).split()
    if len(w) == 1:
        return Person("", "", w[0])
    i = 1
    while i < len(w) - 1 and len(w[i].strip(".")) == 1:
        i += 1
    return Person(w[0], "".join(x.strip(".") for x in w[1:i]), " ".join(w[i:]))


def _given(token: str, dotted: bool, p: Person) -> int | None:
    """Cost of reading ``token`` as the given name (with glued initials); None if it can't be."""
    g = p.given
    if token == g:
        return 0
    if len(token) == 1:
        return 2 if token == g[:1] else None
    if g in NICKNAMES.get(token, "").split():
        return 1
    if len(token) >= 3 and g.startswith(token):
        return 1
    if not dotted and p.middle and token == g + p.middle:
        return 0
    most = 2 if len(g) >= 6 else 1
    d = distance(token, g, most)
    return 2 + d if d <= most and len(token) >= 3 else None


@dataclass(frozen=True)
class Said:
    """A spelling of a person's name taken apart once: its words, and where its comma was."""

    head: tuple[str, ...]
    tail: str | None


def said(spelling: str) -> Said:
    s = person_form(spelling)
    if "," in s:
        head, _, tail = s.partition(",")
        words = tuple(x for x in head.split() if x.strip(".") not in TITLES)
        return Said(words, tail.strip())
    return Said(tuple(x for x in s.split() if x.strip(".") not in TITLES), None)


def _orders(x: Said, k: int) -> list[tuple[str, str]]:
    """The ways to split a spelling into surname of ``k`` words and rest."""
    if x.tail is not None:
        return [(" ".join(x.head), x.tail)]
    w = x.head
    return [(" ".join(w[-k:]), " ".join(w[:-k])), (" ".join(w[:k]), " ".join(w[k:]))] if len(w) > k else []


def _rest_cost(rest: str, p: Person, d: int) -> float | None:
    """The cost of reading what is left beside a surname ``d`` edits away as the given name and initials of ``p``."""
    parts = [(x, x.endswith(".")) for x in rest.replace(".", ". ").split() if x.strip(".") not in TITLES]
    parts = [(x.strip(".,"), dot) for x, dot in parts if x.strip(".,")]
    if not parts:
        return None
    token, dotted = parts[0]
    middles = "".join(x for x, _ in parts[1:])
    c = _given(token, dotted, p)
    if c is None and len(parts) == 1 and len(token) == 2 and token == p.given[:1] + p.middle[:1]:
        c, middles = 2, p.middle
    if c is None and len(parts) == 1 and len(token) > 3 and token[-1:] == p.middle[:1]:
        c = _given(token[:-1], dotted, p)
        middles = p.middle
    if c is None or any(len(x) > 1 for x, _ in parts[1:]) or (middles and middles != p.middle) or (d == 2 and c > 1):
        return None
    return d * 3 + c + (0.5 if p.middle and not middles else 0)


def person_costs(spelling: str, persons: list[Person]) -> list[float | None]:
    """How far a spelling is from meaning each of ``persons``; None where it can't mean the person."""
    x = said(spelling)
    orders: dict[int, list[tuple[str, str, int, int]]] = {}
    near: dict[tuple[str, str], int] = {}
    out: list[float | None] = []
    for p in persons:
        k = p.words
        if k not in orders:
            orders[k] = [(sur, rest, len(sur), letters(sur)) for sur, rest in _orders(x, k)]
        best = None
        for sur, rest, length, bits in orders[k]:
            # two edits are allowed in long surnames that begin alike, else one
            most = 2 if p.length >= 9 and sur[:3] == p.surname[:3] else 1
            if not -most <= length - p.length <= most or (bits ^ p.letters).bit_count() > 2 * most:
                continue
            d = near.get((sur, p.surname))
            if d is None:
                d = near[sur, p.surname] = distance(sur, p.surname, 2)
            if d > most:
                continue
            c = _rest_cost(rest, p, d)
            if c is not None and (best is None or c < best):
                best = c
        out.append(best)
    return out


def person_cost(spelling: str, p: Person) -> float | None:
    return person_costs(spelling, [p])[0]


@lru_cache(maxsize=1024)
def _significant(form: str) -> tuple[str, ...]:
    return tuple(w for w in re.findall(r"[^\W\d_]+", form) if w not in SMALL_WORDS)


def initials(form: str) -> str:
    return "".join(w[0] for w in _significant(form))


def _word_cost(token: str, word: str) -> float | None:
    if token == word:
        return 0
    if token in SHORT:
        return 0.2 if SHORT[token] == word else None
    if word.startswith(token):
        return 0.3
    if len(token) >= 4:
        most = 2 if len(word) >= 8 else 1
        d = distance(token, word, most)
        if d <= most:
            return float(d)
        d = distance(token, word[: len(token)], 1)
        if d <= 1:
            return 0.3 + d
    return None


def journal_cost(spelling: str, journal: str) -> float | None:
    """How far a spelling is from meaning the journal; None if it can't mean it. A word that stands between small words may be left out."""
    form = journal_form(spelling)
    target = _significant(journal_form(journal))
    tokens = _significant(form)
    if len(tokens) == 1 and len(tokens[0]) >= 3 and spelling.strip().isupper():
        return 1.0 if tokens[0] == "".join(w[0] for w in target) else None
    left, cost = list(target), 0.0
    for t in tokens:
        costs = [(c, i) for i, w in enumerate(left) if (c := _word_cost(t, w)) is not None]
        if not costs:
            return _run_together(tokens, target)
        c, i = min(costs)
        cost += c
        left.pop(i)
    if left and not (len(left) == 1 and left[0] in _enclosed(journal_form(journal))):
        return _run_together(tokens, target)
    return cost + (0.5 if left else 0)


def _enclosed(form: str) -> list[str]:
    w = re.findall(r"[^\W\d_]+", form)
    return [y for x, y, z in zip(w, w[1:], w[2:]) if x in SMALL_WORDS and y not in SMALL_WORDS and z in SMALL_WORDS]


def _run_together(tokens: Sequence[str], target: Sequence[str]) -> float | None:
    """The cost when blanks or dots have moved: the letters alone, at most one of them wrong, or the beginnings of all words in a row."""
    said = "".join(tokens)
    if len(said) < 8:
        return None
    d = distance(said, "".join(target), 1)
    if d <= 1:
        return 4.0 + d
    d = _beginnings(said, target)
    return None if d is None else 4.0 + d


def _beginnings(said: str, words: Sequence[str]) -> int | None:
    """0 if ``said`` is a beginning of each word in turn, of at least three letters but for one word; 1 if but for one letter; else None."""

    def reached(x: str, ws: Sequence[str], back: bool) -> list[set[tuple[int, bool]]]:
        out = [{(0, False)}]
        for w in ws:
            now: set[tuple[int, bool]] = set()
            if not out[-1]:
                return out + [now] * (len(ws) + 1 - len(out))
            for at, short in out[-1]:
                for k in range(1 if not short else 3, len(w) + 1):
                    part = w[:k][::-1] if back else w[:k]
                    if x.startswith(part, at):
                        now.add((at + k, short or k < 3))
                    elif not back:
                        break
            out.append(now)
        return out

    ahead = reached(said, words, False)
    if any(at == len(said) for at, _ in ahead[-1]):
        return 0
    behind = reached(said[::-1], words[::-1], True)
    for i, w in enumerate(words):
        if not ahead[i] or not behind[len(words) - 1 - i]:
            continue
        for at, one in ahead[i]:
            for rest, two in behind[len(words) - 1 - i]:
                part = said[at : len(said) - rest]
                if not (one and two) and len(part) >= 3 and any(distance(part, w[:k], 1) <= 1 for k in range(max(3, len(part) - 1), min(len(w), len(part) + 1) + 1)):
                    return 1
    return None


def _near(spelling: str, candidates: list[tuple[int, str, float, int]], kind: str, parsed: dict) -> list[tuple[int, int, bool]]:
    """``(entity, form, exact)`` of the candidates the spelling can mean, as far as they are within ``MARGIN`` of the best."""
    one = {}
    for eid, name, sim, form in candidates:
        if eid not in one or sim > one[eid][1]:
            one[eid] = (name, sim, form)
    ids = sorted(one)
    if kind == "author":
        costs = person_costs(spelling, [parsed.get(i) or parsed.setdefault(i, person(one[i][0])) for i in ids])
    else:
        costs = [journal_cost(spelling, one[i][0]) for i in ids]
    able = [(c, i) for c, i in zip(costs, ids) if c is not None]
    if not able:
        return []
    least = min(able)[0]
    return [(i, one[i][2], one[i][0] == spelling) for c, i in able if c <= least + MARGIN] if least > 0 else [(i, one[i][2], one[i][0] == spelling) for c, i in able if c == 0]


def _forms(kind: str, name: str) -> list[str]:
    """The forms of a reference name that spellings group around."""
    return [person_form(name)] if kind == "author" else [journal_form(name), initials(journal_form(name))]


def _form(kind: str, spelling: str) -> str:
    return person_form(spelling) if kind == "author" else journal_form(spelling)


class Index:
    """The reference vectors as posting lists."""

    def __init__(self, kind: str, rows: list[tuple[int, str]]):
        self.kind, self.ids, self.names, self.form = kind, [], [], []
        vectors = []
        for eid, name in rows:
            for k, f in enumerate(_forms(kind, name)):
                self.ids.append(eid)
                self.names.append(name)
                self.form.append(k)
                vectors.append(grams(f))
        df = Counter(g for v in vectors for g in v)
        n = max(1, len(vectors))
        self.idf = {g: math.log(1 + n / c) for g, c in df.items()}
        self.rare = math.log(1 + n)
        posts: dict[str, list] = defaultdict(list)
        for i, v in enumerate(vectors):
            norm = math.sqrt(sum((c * self.idf[g]) ** 2 for g, c in v.items())) or 1.0
            for g, c in v.items():
                posts[g].append((i, c * self.idf[g] / norm))
        self.posts = {g: (np.array([i for i, _ in p]), np.array([w for _, w in p]), len(p)) for g, p in posts.items()}

    def vector(self, spelling: str) -> dict[str, float]:
        v = grams(_form(self.kind, spelling))
        w = {g: c * self.idf.get(g, self.rare) for g, c in v.items()}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        return {g: x / norm for g, x in w.items()}

    def top(self, v: dict[str, float], n: int = TOP_N) -> list[tuple[int, str, float, int]]:
        hits = [(self.posts[g], x) for g, x in v.items() if g in self.posts]
        if not hits:
            return []
        weights = np.concatenate([p[1] for p, _ in hits]) * np.repeat([x for _, x in hits], [p[2] for p, _ in hits])
        sims = np.bincount(np.concatenate([p[0] for p, _ in hits]), weights, len(self.ids))
        keep = np.flatnonzero(sims >= THRESHOLD[self.kind])
        if len(keep) > n:
            rounded = np.round(sims[keep], 9)
            keep = keep[rounded >= np.partition(rounded, -n)[-n]]
        return [(self.ids[i], self.names[i], x, self.form[i]) for i, x in zip(keep.tolist(), sims[keep].tolist())]


def mentions(sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(kind, row_id, slot, spelling)`` of every author and journal name written in the data."""
    a = sources.select(F.lit("author").alias("kind"), F.col("rec_id").alias("row_id"), F.posexplode("authors").alias("slot", "spelling"))
    a = a.select("kind", F.col("row_id").cast("bigint"), (F.col("slot") + 1).cast("bigint").alias("slot"), "spelling")
    j = profiles.select(F.lit("journal").alias("kind"), F.col("profile_id").cast("bigint").alias("row_id"), F.lit(0).cast("bigint").alias("slot"), F.col("journal_name").alias("spelling"))
    return a.unionByName(j).where("spelling IS NOT NULL AND trim(spelling) <> ''")


def link_spellings(spellings: DataFrame, reference: DataFrame) -> DataFrame:
    """``(kind, spelling, entity_id, exact)`` of the distinct ``(kind, spelling)`` that mean a row of ``reference`` (``kind, entity_id, name``)."""
    size = reference.limit(REFERENCE_ROWS + 1).count()
    if size <= REFERENCE_ROWS:
        rows: dict[str, list] = defaultdict(list)
        for r in reference.where("name IS NOT NULL").orderBy("kind", "entity_id").collect():
            rows[r["kind"]].append((r["entity_id"], r["name"]))
        linked = spellings.mapInPandas(_linker(dict(rows)), _LINKED)
    else:
        linked = candidates_joined(spellings, reference).mapInPandas(_checker, _LINKED)
    return _grouped(durable(linked))


_LINKED = "kind string, spelling string, entity_id bigint, exact boolean, form int, ways int, grams array<string>, weights array<double>"


def _rows(kind: str, s: str, near: list[tuple[int, int, bool]], v: dict[str, float]) -> list[tuple]:
    return [(kind, s, eid, exact, form, len(near), list(v), list(v.values())) for eid, form, exact in near]


def _frame(out: list) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["kind", "spelling", "entity_id", "exact", "form", "ways", "grams", "weights"]).astype({"entity_id": "int64", "exact": "bool", "form": "int32", "ways": "int32"})


def _linker(rows: dict[str, list]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = {k: Index(k, r) for k, r in rows.items()}
        parsed: dict = {}
        for pdf in batches:
            out = []
            for kind, s in zip(pdf["kind"], pdf["spelling"]):
                if kind not in index:
                    continue
                v = index[kind].vector(s)
                top = index[kind].top(v)
                out += _rows(kind, s, _near(s, top, kind, parsed), v) if top else []
            yield _frame(out)

    return run


def candidates_joined(spellings: DataFrame, reference: DataFrame) -> DataFrame:
    """``(kind, spelling, grams, weights, candidates)`` by a join over n-grams, for references of any size."""

    @F.pandas_udf("array<struct<g:string,c:int>>")
    def counted(kind: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([[{"g": g, "c": c} for g, c in grams(f).items()] for f in (_form(k, t) for k, t in zip(kind, text))])

    @F.pandas_udf("array<string>")
    def forms(kind: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([_forms(k, t) for k, t in zip(kind, text)])

    ref = reference.where("name IS NOT NULL").select("kind", "entity_id", "name", F.posexplode(forms("kind", "name")).alias("form", "text"))
    ref = durable(ref.select("*", F.explode(counted("kind", "text")).alias("x")).select("kind", "entity_id", "name", "form", "x.g", "x.c"))
    n = ref.select("kind", "entity_id", "form").distinct().groupBy("kind").agg(F.count("*").alias("n"))
    idf = ref.groupBy("kind", "g").agg(F.count("*").alias("df")).join(F.broadcast(n), "kind").select("kind", "g", F.log(1 + F.col("n") / F.col("df")).alias("idf"))
    vec = ref.join(idf, ["kind", "g"]).withColumn("w", F.col("c") * F.col("idf"))
    norms = vec.groupBy("kind", "entity_id", "form").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vec = vec.join(norms, ["kind", "entity_id", "form"]).withColumn("w", F.col("w") / F.col("norm"))
    said = spellings.select("kind", "spelling", F.explode(counted("kind", "spelling")).alias("x")).select("kind", "spelling", "x.g", "x.c")
    said = said.join(idf, ["kind", "g"], "left").join(F.broadcast(n), "kind").withColumn("w", F.col("c") * F.coalesce("idf", F.log(1 + F.col("n"))))
    whole = said.groupBy("kind", "spelling").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list("g").alias("grams"), F.collect_list("w").alias("ws"))
    sims = said.join(vec.select("kind", "g", "entity_id", "name", "form", F.col("w").alias("rw")), ["kind", "g"]).groupBy("kind", "spelling", "entity_id", "name", "form").agg(F.sum(F.col("w") * F.col("rw")).alias("dot"))
    sims = sims.join(whole.select("kind", "spelling", "norm"), ["kind", "spelling"]).withColumn("sim", F.col("dot") / F.col("norm")).where(F.col("sim") >= F.when(F.col("kind") == "author", THRESHOLD["author"]).otherwise(THRESHOLD["journal"]))
    from pyspark.sql.window import Window as W

    top = sims.withColumn("rk", F.rank().over(W.partitionBy("kind", "spelling").orderBy(F.desc(F.round("sim", 9))))).where(F.col("rk") <= TOP_N)
    cands = top.groupBy("kind", "spelling").agg(F.collect_list(F.struct("entity_id", "name", "sim", "form")).alias("candidates"))
    return cands.join(whole, ["kind", "spelling"]).select("kind", "spelling", "grams", F.transform("ws", lambda x: x / F.col("norm")).alias("weights"), "candidates")


def _checker(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parsed: dict = {}
    for pdf in batches:
        out = []
        for kind, s, g, w, cs in zip(pdf["kind"], pdf["spelling"], pdf["grams"], pdf["weights"], pdf["candidates"]):
            top = [(c["entity_id"], c["name"], c["sim"], c["form"]) for c in cs]
            out += _rows(kind, s, _near(s, top, kind, parsed), dict(zip(g, w)))
        yield _frame(out)


def _grouped(linked: DataFrame) -> DataFrame:
    """``(kind, spelling, entity_id, exact)``: each spelling in the group it has the largest average linkage with.

    Spellings that can mean one entity form its groups, one a form of its name. Their own mean similarity, themselves counted, must reach the
    floor; that of the others, too, and it must be larger than to any other entity.
    """
    key = ["kind", "entity_id", "form"]
    each = linked.select(*key, "spelling", "ways", F.explode(F.arrays_zip("grams", "weights")).alias("x")).select(*key, "spelling", "ways", F.col("x.grams").alias("g"), F.col("x.weights").alias("w"))
    sums = each.where("ways = 1").groupBy(*key, "g").agg(F.sum("w").alias("sw"))
    size = linked.where("ways = 1").groupBy(*key).agg(F.count("*").alias("n"))
    mean = each.join(sums, [*key, "g"]).groupBy(*key, "spelling", "ways").agg(F.sum(F.col("w") * F.col("sw")).alias("dot")).join(size, key)
    near = mean.withColumn("mean", F.round(F.col("dot") / F.col("n"), 9)).where(F.col("mean") >= LINKAGE)
    top = near.groupBy("kind", "spelling").agg(F.max("mean").alias("top"))
    best = near.join(top, ["kind", "spelling"]).where("mean = top").groupBy("kind", "spelling").agg(F.min("entity_id").alias("entity_id"), F.count("*").alias("tied")).where("tied = 1").select("kind", "spelling", "entity_id")
    return linked.join(best, ["kind", "spelling", "entity_id"], "left_semi").select("kind", "spelling", "entity_id", "exact")


def link(said: DataFrame, reference: DataFrame) -> DataFrame:
    """``(kind, row_id, slot, entity_id, exact)``: every mention (``kind, row_id, slot, spelling``) that means a reference entity."""
    keyed = said.withColumn("key", F.concat_ws(":", "kind", "spelling"))
    counts = durable(keyed.groupBy("key", "kind", "spelling").agg(F.count("*").alias("n")))
    linked = link_spellings(counts.select("kind", "spelling"), reference).select(F.concat_ws(":", "kind", "spelling").alias("key"), "entity_id", "exact")
    return salted_lookup(keyed.select("key", "kind", "row_id", "slot"), linked, "key", hot_keys(counts, "key"), "row_id").select("kind", "row_id", "slot", "entity_id", "exact")
