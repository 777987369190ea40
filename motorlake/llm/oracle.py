"""Plain SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from motorlake.llm.line_dedup import MIN_CHARS, MIN_DOCS
from motorlake.llm.quality import RULES, STOP_WORDS, WINDOW

WHITE_SQL = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, {WHITE_SQL}), '{UPPER}', '{LOWER}') AS key FROM l),
shared AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.*, coalesce(doc_id < keeper, false) AS lost FROM k LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY r, doc_id"""


def _fails() -> str:
    tests = [f"{r.metric} < {r.low}" for r in RULES if r.low is not None] + [f"{r.metric} > {r.high}" for r in RULES if r.high is not None]
    return " OR ".join(tests)


_STOP = ", ".join(f"'{w}'" for w in sorted({w for own in STOP_WORDS.values() for w in own}))

QUALITY = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
places AS (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW}),
seen AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS window_text FROM places),
twice AS (SELECT r, i FROM seen QUALIFY count(*) OVER (PARTITION BY r, window_text) >= 2),
repeats AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM twice, range({WINDOW}) AS s(j) GROUP BY r),
m AS (SELECT w.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS n_stop,
      len(list_filter(ws, lambda x: regexp_matches(x, '\pL'))) AS n_alpha, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len(list_filter(ws, lambda x: ends_with(x, '!'))) AS n_bang
      FROM w LEFT JOIN repeats USING (r)),
s AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio, coalesce(n_stop / nullif(n_words, 0), 0) AS stop_ratio,
      coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio, coalesce(n_alpha / nullif(n_words, 0), 0) AS alpha_word_ratio, coalesce(n_upper / nullif(word_chars, 0), 0) AS upper_ratio,
      coalesce(n_bang / nullif(n_words, 0), 0) AS bang_ratio, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_fails()}) AS kept FROM s"""

ORACLE_SQL = {"op1_line_dedup": LINE_DEDUP, "op5_quality_rules": QUALITY}
