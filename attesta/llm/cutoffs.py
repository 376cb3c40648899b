"""Texts whose end is missing.

How often the last three words of a text end distinct texts is compared with how often the same words go on inside texts (in a longer
last word, which is a cut inside a word, in a mark or in further words), in SQL. Words keep their marks, so a sentence mark is part of the
last word. The share of occurrences that end a text is smoothed by that of the last two words, this by that of the last one, and
this by that of all words with the same kind of mark; the ending itself does not count. An ending is cut if it ends texts
less often than any word does, which is how its words would end texts if authors stopped anywhere.

What a text is closed or broken off with is looked at first: closing quotation marks, keyword lines, registration numbers,
addresses and bracketed remarks are ends, while dropped-text marks, opening brackets, broken character references, damaged
characters and abbreviations are not, however often they end texts.

Defined cases
    NULL, empty and blank texts are no texts: they are never cut and not counted in shares. Texts of one or two words
    have their last words padded at the front. Exact copies of a text count once in the statistics, all of them are
    reported. Sources that are NULL form one group. Long words count by their first characters and the last one (``WORD``), figures as one figure.
    Texts are judged whole, whatever their length. An ending that ends texts exactly as often as any word does is cut unless it has a sentence mark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from attesta.llm.skeletons import LOOK_ALIKE
from attesta.operators.durable import durable

# Abbreviations that end in a dot without ending a sentence.
ABBREVIATIONS = ("e.g.", "i.e.", "cf.", "vs.", "fig.", "figs.", "eq.", "eqs.", "ref.", "refs.", "approx.", "no.", "z.b.", "d.h.", "p.ej.", "resp.")

#: So many occurrences of fewer words weigh as much as all occurrences of more words.
PRIOR = 20
#: The last words that are reported occur at least so often.
LEAST_ENDS = 20
#: Longer words count by so many characters, the first ones and the last one.
WORD = 24

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_FROM = _WIDE + "".join(x[0] for x in LOOK_ALIKE)
_TO = _PLAIN + "".join(x[1] for x in LOOK_ALIKE)
_UNSEEN = r"[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]"
_SPACES = r"[\\s\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]+"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _word(x: str) -> str:
    return f"IF(length({x}) > {WORD}, left({x}, {WORD - 1}) || right({x}, 1), {x})"


def _sql(text: str, **frames: DataFrame) -> DataFrame:
    """``text`` with each ``{name}`` standing for a frame; the views it takes exist only while it is analysed."""
    spark = next(iter(frames.values())).sparkSession
    views = {k: f"attesta_{k}_{uuid.uuid4().hex}" for k in frames}
    for k, view in views.items():
        frames[k].createOrReplaceTempView(view)
        text = text.replace("{" + k + "}", view)
    try:
        return spark.sql(text)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


# Each distinct text once, in its normal form.
_FORMS = f"""
SELECT t, trim(regexp_replace(lower(translate(regexp_replace(body, '{_UNSEEN}', ''), {_quoted(_FROM)}, {_quoted(_TO)})), '{_SPACES}', ' ')) AS txt
FROM (SELECT xxhash64(body) AS t, any_value(body) AS body FROM {{texts}} WHERE body IS NOT NULL GROUP BY xxhash64(body))
"""

# What a text is closed or broken off with: 1 (broken off), 0 (closed), 2 (left to the counts), 3 (no visible character); and its last three words.
_ENDS = f"""
SELECT t, said, array_join(w, ' ') AS w, coalesce(get(w, size(w) - 3), '') AS a, coalesce(get(w, size(w) - 2), '') AS b, w[size(w) - 1] AS c
FROM (
  SELECT t, transform(split(regexp_replace(txt, '[0-9]+', '9'), ' '), x -> {_word("x")}) AS w,
    CASE
      WHEN txt = '' THEN 3
      WHEN endswith(tok, '..') OR tok RLIKE '(…|\\\\[\\\\.*\\\\]|\\\\(\\\\.*\\\\)|[�(\\\\[{{<«„“-]|^&[a-z]{{0,5}})$' THEN 1
      WHEN contains(txt, 'keyword') AND substring_index(txt, 'keyword', -1) RLIKE '^s?: ?[^.!?]*$' THEN 0
      WHEN contains(tok, '-') AND substring_index(tok, '-', -1) RLIKE '^[0-9]{{3,}}$' AND right(left(tok, length(tok) - length(substring_index(tok, '-', -1)) - 1), 2) RLIKE '^[a-z]{{2}}$' THEN 0
      WHEN contains(tok, 'http') AND substring_index(tok, 'http', -1) RLIKE '^s?://.' THEN 0
      WHEN endswith(txt, ')') AND contains(txt, '(') AND instr(substring_index(txt, '(', -1), ')') = length(substring_index(txt, '(', -1)) THEN 0
      WHEN endswith(txt, ']') AND contains(txt, '[') AND instr(substring_index(txt, '[', -1), ']') = length(substring_index(txt, '[', -1)) THEN 0
      WHEN tok IN ({", ".join(_quoted(x) for x in ABBREVIATIONS)}) THEN 1
      WHEN tok RLIKE '[”"»]$' THEN 0
      ELSE 2
    END AS said
  FROM (SELECT t, txt, substring_index(txt, ' ', -1) AS tok FROM {{forms}})
)
"""

# The kind of a word: 1 (it closes a sentence), 2 (another mark) or 0 (letters and figures).
_MARK = r"""CASE WHEN c RLIKE '[.!?。！？][)\\]"”»’\']*$' THEN 1 WHEN c RLIKE '[^\\p{L}\\p{M}\\p{N}]$' THEN 2 ELSE 0 END"""

# How often each three words stand in a row, the last ones of a text and the padded first ones with them.
_GRAMS = """
SELECT g.a, g.b, g.c, count(*) AS n
FROM (
  SELECT explode(transform(w, (x, i) -> struct(IF(i > 1, w[i - 2], '') AS a, IF(i > 0, w[i - 1], '') AS b, x AS c))) AS g
  FROM (SELECT split(w, ' ') AS w FROM {ends} WHERE said < 3)
)
GROUP BY g.a, g.b, g.c
"""

# For the last three, two and one words of the endings left to the counts: how many texts end so, and how often the same words go on.
_LEVELS = """
SELECT o.level, o.k, o.ends, coalesce(p.n, 0) - o.ends AS inside
FROM (SELECT level, k, count(*) AS ends FROM {open} LATERAL VIEW posexplode(array(xxhash64(1, c), xxhash64(2, b, c), xxhash64(3, a, b, c))) AS level, k GROUP BY level, k) o
LEFT JOIN (
  SELECT k, sum(n) AS n
  FROM (
    SELECT n, explode(flatten(transform(sequence(1, greatest(length(c), 1)), i -> array(xxhash64(1, left(c, i)), xxhash64(2, b, left(c, i)), xxhash64(3, a, b, left(c, i)))))) AS k
    FROM {grams}
  )
  GROUP BY k
) p ON o.k = p.k
"""

# For each kind of word how many texts it ends and how often it occurs; kind 9 is any word.
_KINDS = f"""
SELECT mark, sum(ends) AS ends, sum(n) AS n
FROM (
  SELECT {_MARK} AS mark, 0 AS ends, n FROM {{grams}} UNION ALL SELECT {_MARK} AS mark, 1 AS ends, 0 AS n FROM {{open}}
  UNION ALL SELECT 9 AS mark, 0 AS ends, n FROM {{grams}} UNION ALL SELECT 9 AS mark, 1 AS ends, 0 AS n FROM {{ends}} WHERE said < 3
)
GROUP BY mark
"""

# The counts of the last one, two and three words of each ending side by side.
_BEST = """
SELECT t, any_value(mark) AS mark, max(IF(level = 0, ends, NULL)) AS e1, max(IF(level = 0, inside, NULL)) AS i1, max(IF(level = 1, ends, NULL)) AS e2, max(IF(level = 1, inside, NULL)) AS i2, max(IF(level = 2, ends, NULL)) AS e3, max(IF(level = 2, inside, NULL)) AS i3
FROM (SELECT t, {mark} AS mark, explode(array(xxhash64(1, c), xxhash64(2, b, c), xxhash64(3, a, b, c))) AS k FROM {open}) e JOIN {levels} l ON e.k = l.k
GROUP BY t
"""

_JUDGED = f"""
SELECT t, IF(mark = 1, p3 < usual, p3 <= usual) AS cut, CASE WHEN e3 + i3 >= {LEAST_ENDS} THEN i3 WHEN e2 + i2 >= {LEAST_ENDS} THEN i2 WHEN e1 + i1 >= {LEAST_ENDS} THEN i1 END AS inside, CASE WHEN e3 + i3 >= {LEAST_ENDS} THEN e3 WHEN e2 + i2 >= {LEAST_ENDS} THEN e2 WHEN e1 + i1 >= {LEAST_ENDS} THEN e1 END AS ends
FROM (
  SELECT *, (e3 - 1 + {PRIOR} * p2) / (e3 + i3 - 1 + {PRIOR}) AS p3
  FROM (
    SELECT *, (e2 - 1 + {PRIOR} * p1) / (e2 + i2 - 1 + {PRIOR}) AS p2
    FROM (SELECT b.*, u.ends / u.n AS usual, (e1 - 1 + {PRIOR} * m.ends / m.n) / (e1 + i1 - 1 + {PRIOR}) AS p1 FROM {{best}} b JOIN {{kinds}} m ON b.mark = m.mark JOIN {{kinds}} u ON u.mark = 9)
  )
)
"""

_VERDICT = """
SELECT x.part, x.rid, x.source, CASE e.said WHEN 2 THEN b.cut ELSE e.said = 1 END AS cut, b.inside, b.ends
FROM (SELECT part, rid, source, xxhash64(body) AS t FROM {texts} WHERE body IS NOT NULL) x
JOIN (SELECT t, said FROM {ends} WHERE said < 3) e ON x.t = e.t
LEFT JOIN {judged} b ON e.t = b.t
"""


def verdicts(texts: DataFrame) -> DataFrame:
    """``(part, rid, source, cut, inside, ends)`` for each text that has a visible character.

    ``texts`` has ``(part, rid, source, body)``. For an ending left to the counts ``inside`` and ``ends`` say how often the longest last words
    that occur ``LEAST_ENDS`` times go on and how often they end a distinct text; both are NULL if even the last word is too rare.
    """
    ends = durable(_sql(_ENDS, forms=_sql(_FORMS, texts=texts)))
    open_ends = ends.where("said = 2").select("t", "a", "b", "c")
    grams = durable(_sql(_GRAMS, ends=ends))
    levels = _sql(_LEVELS, open=open_ends, grams=grams)
    kinds = durable(_sql(_KINDS, grams=grams, open=open_ends, ends=ends))  # four rows
    judged = _sql(_JUDGED, best=_sql(_BEST.replace("{mark}", _MARK), open=open_ends, levels=levels), kinds=kinds)
    return _sql(_VERDICT, texts=texts, ends=ends, judged=judged)


def shares(v: DataFrame) -> DataFrame:
    """``(table_name, source, texts, cut, share)``: how many texts of each source were cut."""
    return _sql(
        "SELECT part AS table_name, source, count(*) AS texts, count_if(cut) AS cut, round(count_if(cut) / count(*), 6) AS share FROM {v} GROUP BY part, source",
        v=v,
    )
