"""DuckDB SQL for the operators that SQL can express; it runs over the same whole tables."""

from __future__ import annotations

from .quality import RULES, STOP_WORDS

_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM benchmark),
i AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
items AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS gram FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
places AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM items))),
hits AS (SELECT doc_id, item, n, s FROM places JOIN items USING (n, gram)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""

LINES = r"""
WITH l AS (SELECT doc_id, source, unnest(range(1, len(x) + 1)) AS place, unnest(x) AS line
  FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
wide AS (SELECT line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1 HAVING count(DISTINCT coalesce('=' || source, '')) >= 8)
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(l.line, '[^\x20\x09-\x0D]')) AS n_lines, count(wide.line) AS n_removed,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY place) FILTER (WHERE wide.line IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN wide ON l.line = wide.line GROUP BY doc_id"""


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {part} / {whole} ELSE 0 END"


_MEASURES = {
    "n_words": "n_words", "stop_words": "stop_words", "repeat_share": _share("n_repeat_words", "n_words"), "mean_word_chars": _share("word_chars", "n_words"),
    "symbol_ratio": _share("n_symbols", "n_words"), "alphabetic_share": _share("n_alphabetic", "n_words"), "dup_line_share": _share("n_dup_lines", "n_lines"),
    "bullet_line_share": _share("n_bullets", "n_lines"), "ellipsis_line_share": _share("n_ellipses", "n_lines"),
}


def _elsewhere(langs: tuple[str, ...] | None) -> str:
    return "" if langs is None else f"NOT coalesce(lower(lang) IN ({', '.join(repr(x) for x in langs)}), FALSE) OR "


_LIMITS = " AND ".join(
    f"({_elsewhere(r.langs)}{_MEASURES[r.measure]} {sign} {limit})" for r in RULES for sign, limit in ((">=", r.least), ("<=", r.most)) if limit is not None
)

QUALITY = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (SELECT doc_id, s, w[s] AS a, w[s + 1] AS b, w[s + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d))),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([s, s + 1, s + 2]) AS p FROM g WHERE n > 1) GROUP BY 1),
c AS (SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))}))) AS stop_words,
  len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alphabetic,
  len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣–]'))) AS n_bullets,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses
  FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, {", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))},
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {_LIMITS} AS kept
FROM c"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY gram) AS least FROM g) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM late),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

MINHASH = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 3], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * m >= 80 * (x.n + y.n - m)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)"""

SEARCH = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM documents),
held AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, w FROM d WHERE len(w) > 0),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM held),
items AS (SELECT item_id, list_distinct(regexp_extract_all({_LOWER}, '{_PLAIN}')) AS terms FROM benchmark),
asked AS (SELECT item_id, unnest(terms) AS term FROM items),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM held) SEMI JOIN asked USING (term) GROUP BY 1, 2, 3),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term, n_docs),
gain AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS gain FROM tf JOIN weight USING (term), corpus),
scores AS (SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM asked JOIN gain USING (term) GROUP BY 1, 2 HAVING sum(gain) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""

ORACLES = {
    "op1_decontaminate": DECONTAMINATE, "op3_lines": LINES, "op4_quality": QUALITY, "op8_substrings": SUBSTRINGS, "op10_minhash": MINHASH,
    "op11_search": SEARCH,
}
