"""Stems, places and cover density as SQL, for comparison: regular expressions over the distinct words of a table."""

from __future__ import annotations

from palimpsest.functions import stems as st


def _list(values: object) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _swap(rules: dict[str, str], e: str) -> str:
    return f"CASE {e} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.items()) + " END"


def _end(endings: object) -> str:
    return f"regexp_extract(w, '({'|'.join(endings)})$')"


_LONG = "(len(w) - len(e) >= {})"
_SHORT = "regexp_matches({}, '([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$')"
_DOUBLE = "regexp_matches(x, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')"


def stems(words: str) -> str:
    """(word, stem) of the distinct words of ``words``, a SELECT of one column w."""
    part = "regexp_extract({}, '^.*?[aeiouy][^aeiouy]')"
    head = f"regexp_extract(w, '^({'|'.join(st.HEADS)})')"
    return f"""
WITH p0 AS (SELECT w AS word, regexp_replace(w, '(^|[aeiouy])y', '\\1Y', 'g') AS w FROM (SELECT DISTINCT w FROM ({words}))),
p1 AS (SELECT *, CASE WHEN {head} <> '' THEN len({head}) WHEN {part.format('w')} <> '' THEN len({part.format('w')}) ELSE len(w) END AS r1 FROM p0),
p2 AS (SELECT *, CASE WHEN {part.format('w[r1 + 1:]')} <> '' THEN r1 + len({part.format('w[r1 + 1:]')}) ELSE len(w) END AS r2 FROM p1),
p3 AS (SELECT word, r1, r2, CASE WHEN w LIKE '%sses' THEN w[:-3] WHEN w LIKE '%ied' OR w LIKE '%ies' THEN CASE WHEN len(w) > 4 THEN w[:-3] ELSE w[:-2] END
  WHEN w LIKE '%s' AND w NOT LIKE '%us' AND w NOT LIKE '%ss' AND regexp_matches(w, '[aeiouy].*..$') THEN w[:-2] ELSE w END AS w FROM p2),
p4 AS (SELECT *, {_end(('eedly', 'ingly', 'edly', 'eed', 'ing', 'ed'))} AS e FROM p3),
p5 AS (SELECT *, CASE WHEN e NOT IN ('', 'eed', 'eedly') AND regexp_matches(w[:len(w) - len(e)], '[aeiouy]') THEN w[:len(w) - len(e)] END AS x FROM p4),
p6 AS (SELECT word, r1, r2, CASE WHEN e IN ('eed', 'eedly') THEN CASE WHEN {_LONG.format('r1')} THEN w[:len(w) - len(e)] || 'ee' ELSE w END WHEN x IS NULL THEN w
  WHEN regexp_matches(x, '(at|bl|iz)$') OR ({_SHORT.format('x')} AND len(x) <= r1 AND NOT {_DOUBLE}) THEN x || 'e' WHEN {_DOUBLE} THEN x[:-2] ELSE x END AS w FROM p5),
p7 AS (SELECT word, r1, r2, regexp_replace(w, '^(.+)([^aeiouy])[yY]$', '\\1\\2i') AS w FROM p6),
p8 AS (SELECT *, {_end(sorted(st.STEP2, key=len, reverse=True))} AS e FROM p7),
p9 AS (SELECT word, r1, r2, CASE WHEN e <> '' AND {_LONG.format('r1')} AND (e <> 'ogi' OR w LIKE '%logi') AND (e <> 'li' OR regexp_matches(w, '[cdeghkmnrt]li$'))
  THEN w[:len(w) - len(e)] || {_swap(st.STEP2, 'e')} ELSE w END AS w FROM p8),
p10 AS (SELECT *, {_end(sorted(st.STEP3, key=len, reverse=True))} AS e FROM p9),
p11 AS (SELECT word, r1, r2, CASE WHEN e <> '' AND len(w) - len(e) >= CASE e WHEN 'ative' THEN r2 ELSE r1 END THEN w[:len(w) - len(e)] || {_swap(st.STEP3, 'e')} ELSE w END AS w FROM p10),
p12 AS (SELECT *, {_end(sorted(st.STEP4, key=len, reverse=True))} AS e FROM p11),
p13 AS (SELECT word, r1, r2, CASE WHEN e <> '' AND {_LONG.format('r2')} AND (e <> 'ion' OR regexp_matches(w, '[st]ion$')) THEN w[:len(w) - len(e)] ELSE w END AS w FROM p12),
p14 AS (SELECT word, CASE WHEN w LIKE '%e' AND (len(w) - 1 >= r2 OR len(w) - 1 >= r1 AND NOT {_SHORT.format('w[:-2]')}) OR w LIKE '%ll' AND len(w) - 1 >= r2 THEN w[:-2] ELSE w END AS w FROM p13)
SELECT p14.word, CASE WHEN len(p14.word) < 3 THEN p14.word WHEN p14.word IN ({_list(st.ODD)}) THEN {_swap(st.ODD, 'p14.word')} WHEN p3.w IN ({_list(sorted(st.KEPT))}) THEN p3.w ELSE lower(p14.w) END AS stem
FROM p14 JOIN p3 ON p14.word = p3.word WHERE p14.word NOT IN ({_list(sorted(st.STOP))})"""


def scores(source: str, columns: str, question: str, text: str = "k.text") -> str:
    """The columns and score of rows of ``source`` (alias k) that hold a stem of the question."""
    names = columns.replace("k.", "")
    words = f"SELECT {columns}, unnest(regexp_extract_all(lower({text}), '[\\pL\\pN]+')) AS w FROM {source}"
    return (f"SELECT {names}, round(n / (n + 10.0::DOUBLE), 6) AS score FROM (SELECT {names}, count(*) AS n FROM ({words}) JOIN ({stems(f'SELECT w FROM ({words})')}) s ON s.word = w "
            f"WHERE stem IN ({_list(st.question_stems(question)) or 'NULL'}) GROUP BY {names})")


def near(source: str, columns: str, question: str, text: str = "k.text") -> str:
    """The columns and score of rows that hold all stems: a cover starts at a place if no later start ends at the same place."""
    names, asked = columns.replace("k.", ""), st.question_stems(question)
    lists = f"SELECT {columns}, regexp_extract_all(lower({text}), '[\\pL\\pN]+') AS l FROM {source}"
    words = f"SELECT {names}, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i FROM ({lists})"
    ends = ", ".join(f"min(CASE WHEN stem = '{s}' THEN i END) OVER w AS e{k}" for k, s in enumerate(asked))
    far, full = ", ".join(f"e{k}" for k in range(len(asked))), " AND ".join(f"e{k} IS NOT NULL" for k in range(len(asked)))
    return (f"SELECT {names}, round(r / (r + 1), 6) AS score FROM (SELECT {names}, sum(0.1::DOUBLE / (1 + b - a - (nb - na))) AS r FROM ("
            f"SELECT {names}, greatest({far}) AS b, max(i) AS a, max(n) AS na, max(n) + count(*) - 1 AS same, max_by(nb, i) AS nb FROM ("
            f"SELECT x.*, y.n AS nb FROM (SELECT *, {ends}, row_number() OVER (PARTITION BY {names} ORDER BY i) AS n FROM (SELECT {names}, i, stem FROM ({words}) JOIN ({stems(f'SELECT w FROM ({words})')}) s ON s.word = w WHERE stem IN ({_list(asked)})) "
            f"WINDOW w AS (PARTITION BY {names} ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) x "
            f"JOIN (SELECT {names}, i, row_number() OVER (PARTITION BY {names} ORDER BY i) AS n FROM (SELECT {names}, i FROM ({words}) JOIN ({stems(f'SELECT w FROM ({words})')}) s ON s.word = w WHERE stem IN ({_list(asked)}))) y "
            f"ON {' AND '.join(f'x.{c.strip()} = y.{c.strip()}' for c in names.split(','))} AND y.i = greatest({far}) WHERE {full}) GROUP BY {names}, greatest({far})) GROUP BY {names})")
