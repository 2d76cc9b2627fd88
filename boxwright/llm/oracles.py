"""DuckDB SQL of the queries that SQL can express: op2 and op9. Fixed values are written out, not taken from the operators' plans."""

from __future__ import annotations

from boxwright.llm.quality import MENU_WORDS, PHRASES

_B = r"[\x20\x09-\x0D]"
_W = r"[^\x20\x09-\x0D]"


def _any(words: list[str]) -> str:
    return "(?i)(" + "|".join(w.replace("'", ".") for w in words) + ")"


def _n(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{_W}+'))"


# RE2 has no look-around: a / or > between blanks becomes a | in two steps.
_CUT = rf"regexp_replace(regexp_replace(regexp_replace(l, '([ \x09-\x0D])[/>]', '\1' || chr(1), 'g'), '\x01([ \x09-\x0D])', '|\1', 'g'), '[·•›»→]', '|', 'g')"

OP2 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w0 AS (SELECT r, regexp_extract_all(t, '{_W}+') AS ws FROM d),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w0),
g0 AS (SELECT r, i, CASE WHEN lead(w, 4) OVER o IS NOT NULL THEN w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o END AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, CASE WHEN g IS NULL THEN 0 WHEN count(*) OVER (PARTITION BY r, g) > 1 THEN 1 ELSE 0 END AS again FROM g0),
c0 AS (SELECT r, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM g),
c AS (SELECT r, sum(c) AS n_repeat_words FROM c0 GROUP BY r),
l0 AS (SELECT r, string_split(t, chr(10)) AS ls FROM d),
l1 AS (SELECT r, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM l0),
l2 AS (SELECT r, l, row_number() OVER (PARTITION BY r ORDER BY pos) AS pos FROM l1 WHERE regexp_matches(l, '{_W}')),
l3 AS (SELECT *, {_CUT} AS cut, {_n("l")} AS n, length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) AS symbols, length(regexp_replace(l, '\P{{Lu}}', '', 'g')) AS upper, length(regexp_replace(l, '\P{{L}}', '', 'g')) AS letters,
  length(regexp_replace(l, '[^!]', '', 'g')) AS shouts, length(regexp_replace(l, '[^\p{{P}}\p{{S}}]', '', 'g')) AS marks, length(regexp_replace(l, '[^\p{{L}}\p{{N}}]', '', 'g')) AS alnum FROM l2),
l4 AS (SELECT *, n <= 3 AND NOT regexp_matches(l, '[.!?:;,…][\p{{Pe}}\p{{Pf}}"]*{_B}*$') AS short, string_split(cut, '|') AS items FROM l3),
l5 AS (SELECT *, pos - row_number() OVER (PARTITION BY r, short ORDER BY pos) AS isle FROM l4),
l6 AS (SELECT *, short AND count(*) OVER (PARTITION BY r, short, isle) >= 4 AS listed FROM l5),
l7 AS (SELECT r, l, listed OR 3 * symbols >= n OR marks >= 3 AND 2 * marks >= alnum OR shouts >= n AND 2 * upper >= letters OR length(l) <= 200 AND regexp_matches(l, $p${_any(PHRASES)}$p$)
  OR length(l) <= 40 AND regexp_matches(l, $p$(?i)^{_B}*{_any(MENU_WORDS)}{_B}*$$p$) OR len(items) >= 3 AND len(list_filter(items, lambda x: {_n("x")} > 3)) = 0 AS fails FROM l6),
k AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines, sum(CASE WHEN fails THEN 0 ELSE length(regexp_replace(l, '{_B}', '', 'g')) END) AS left_chars FROM l7 GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '{_B}', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(left_chars, 0) AS left_chars FROM d JOIN w0 USING (r) LEFT JOIN c USING (r) LEFT JOIN k USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * left_chars >= 50 * word_chars AS kept, CAST(CASE WHEN base_failed THEN 0 ELSE left_chars END AS BIGINT) AS kept_chars FROM v"""

_SAFE = "replace({}, '<|', '<' || chr(8205) || '|')"

OP9 = rf"""WITH t0 AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, role IS DISTINCT FROM 'system' AS late FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY late, turn NULLS FIRST, role NULLS FIRST, text) - 1 AS seq FROM t0),
people AS (SELECT DISTINCT conv_id AS conv, role AS speaker FROM t WHERE late),
s0 AS (SELECT conv_id, speaker, seq, role IS NOT DISTINCT FROM speaker AS own, text, '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role IS NOT DISTINCT FROM speaker THEN 'assistant' WHEN role IS NULL THEN 'user' ELSE 'user name=' || {_SAFE.format(r"regexp_replace(role, '[\p{Cc}\x{2028}\x{2029}]', ' ', 'g')")} END || chr(10) AS head FROM t JOIN people ON conv_id IS NOT DISTINCT FROM conv),
s AS (SELECT *, head || {_SAFE.format("text")} || '<|im_end|>' || chr(10) AS segment FROM s0),
o AS (SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM s)
SELECT conv_id, speaker, CAST(seq // 64 AS BIGINT) AS part, CAST(min(pos) AS BIGINT) AS start, count(*) AS n_turns, string_agg(segment, '' ORDER BY seq) AS text,
  coalesce(string_agg(CASE WHEN own THEN (pos + length(head)) || ':' || (pos + length(segment) - 1) END, ',' ORDER BY seq), '') AS mask FROM o GROUP BY conv_id, speaker, seq // 64"""
