"""DuckDB SQL of the queries of this package that SQL can express."""

from __future__ import annotations

from attesta.llm.cutoffs import _FROM, _TO, ABBREVIATIONS, LEAST_ENDS, PRIOR, WORD


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_UNSEEN = r"[\x{00ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]"
_SPACES = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+"
_MARK = """CASE WHEN regexp_matches(c, '[.!?。！？][)\\]"”»’'']*$') THEN 1 WHEN regexp_matches(c, '[^\\p{L}\\p{M}\\p{N}]$') THEN 2 ELSE 0 END"""

_VERDICTS = f"""
WITH texts AS (
  SELECT 'academic_sources' AS part, rec_id AS rid, source, content AS body FROM academic_sources
  UNION ALL SELECT 'evidence_items', item_id, harvested_from, evidence FROM evidence_items
), forms AS (
  SELECT body, trim(regexp_replace(lower(translate(regexp_replace(body, '{_UNSEEN}', '', 'g'), {_q(_FROM)}, {_q(_TO)})), '{_SPACES}', ' ', 'g')) AS txt
  FROM (SELECT DISTINCT body FROM texts WHERE body IS NOT NULL)
), tails AS (
  SELECT body, txt, string_split(txt, ' ')[-1] AS tok, string_split(txt, 'keyword')[-1] AS kw, string_split(txt, '(')[-1] AS round, string_split(txt, '[')[-1] AS square FROM forms
), said AS (
  SELECT body, list_transform(string_split(regexp_replace(txt, '[0-9]+', '9', 'g'), ' '), lambda x: CASE WHEN length(x) > {WORD} THEN left(x, {WORD - 1}) || right(x, 1) ELSE x END) AS w,
    CASE
      WHEN txt = '' THEN 3
      WHEN suffix(tok, '..') OR regexp_matches(tok, '(…|\\[\\.*\\]|\\(\\.*\\)|[�(\\[{{<«„“-]|^&[a-z]{{0,5}})$') THEN 1
      WHEN contains(txt, 'keyword') AND regexp_matches(kw, '^s?: ?[^.!?]*$') THEN 0
      WHEN regexp_matches(tok, '([a-z]{{2,}}-[0-9]{{3,}}|https?://[^ ]+)$') THEN 0
      WHEN suffix(txt, ')') AND contains(txt, '(') AND instr(round, ')') = length(round) THEN 0
      WHEN suffix(txt, ']') AND contains(txt, '[') AND instr(square, ']') = length(square) THEN 0
      WHEN tok IN ({", ".join(map(_q, ABBREVIATIONS))}) THEN 1
      WHEN regexp_matches(tok, '[”"»]$') THEN 0
      ELSE 2
    END AS said
  FROM tails
), words AS (
  SELECT body, said, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] ELSE '' END AS b, CASE WHEN i > 2 THEN w[i - 2] ELSE '' END AS a, i = len(w) AS last
  FROM (SELECT body, said, w, unnest(range(1, len(w) + 1)) AS i FROM said WHERE said < 3)
), grams AS (SELECT a, b, c, count(*) AS n FROM words GROUP BY a, b, c),
open AS (SELECT body, a, b, c, {_MARK} AS mark FROM words WHERE last AND said = 2),
heads AS (SELECT a, b, left(c, i) AS c, n FROM (SELECT a, b, c, n, unnest(range(1, greatest(length(c), 1) + 1)) AS i FROM grams)),
n3 AS (SELECT a, b, c, sum(n) AS n FROM heads SEMI JOIN open USING (a, b, c) GROUP BY a, b, c), n2 AS (SELECT b, c, sum(n) AS n FROM heads SEMI JOIN open USING (b, c) GROUP BY b, c), n1 AS (SELECT c, sum(n) AS n FROM heads SEMI JOIN open USING (c) GROUP BY c),
d3 AS (SELECT a, b, c, count(*) AS e FROM open GROUP BY a, b, c), d2 AS (SELECT b, c, count(*) AS e FROM open GROUP BY b, c), d1 AS (SELECT c, count(*) AS e FROM open GROUP BY c),
kinds AS (SELECT mark, sum(n) AS n FROM (SELECT {_MARK} AS mark, n FROM grams) GROUP BY mark), closed AS (SELECT mark, count(*) AS e FROM open GROUP BY mark),
usual AS (SELECT (SELECT count(*) FROM said WHERE said < 3) / (SELECT sum(n) FROM grams) AS p),
p1 AS (SELECT o.*, (d1.e - 1 + {PRIOR} * closed.e / kinds.n) / (n1.n - 1 + {PRIOR}) AS p FROM open o JOIN n1 USING (c) JOIN d1 USING (c) JOIN kinds USING (mark) JOIN closed USING (mark)),
p2 AS (SELECT o.* EXCLUDE (p), (d2.e - 1 + {PRIOR} * o.p) / (n2.n - 1 + {PRIOR}) AS p FROM p1 o JOIN n2 USING (b, c) JOIN d2 USING (b, c)),
p3 AS (SELECT o.* EXCLUDE (p), (d3.e - 1 + {PRIOR} * o.p) / (n3.n - 1 + {PRIOR}) AS p FROM p2 o JOIN n3 USING (a, b, c) JOIN d3 USING (a, b, c)),
judged AS (SELECT body, CASE WHEN mark = 1 THEN p3.p < usual.p ELSE p3.p <= usual.p END AS cut FROM p3, usual),
verdicts AS (
  SELECT x.part, x.rid, x.source, CASE s.said WHEN 2 THEN j.cut ELSE s.said = 1 END AS cut
  FROM texts x JOIN said s ON x.body = s.body AND s.said < 3 LEFT JOIN judged j ON s.body = j.body
)
"""

SQL = {
    "p4_found": _VERDICTS + "SELECT part AS table_name, rid AS row_id FROM verdicts WHERE cut",
    "p4_shares": _VERDICTS + "SELECT part AS table_name, source, count(*) AS texts, CAST(count_if(cut) AS BIGINT) AS cut, round(count_if(cut) / count(*), 6) AS share FROM verdicts GROUP BY part, source",
}
