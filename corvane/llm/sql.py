"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

from corvane.llm.rules import BOILERPLATE, LineRules

R = LineRules()

_LINE_FAILS = rf"""(
    len(regexp_extract_all(x, '\|')) >= {R.nav_separators}
    OR len(regexp_extract_all(x, '[#*$%&|<>]')) * 100 > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) * {R.max_symbol_pct}
    OR len(regexp_extract_all(x, '!!')) * 100 > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) * {R.max_shout_pct}
    OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) < {R.short_line_words} AND NOT regexp_matches(rtrim(x, ' '), '[.!?:;…。！？"''”’»)\]}}]$'))
    OR regexp_matches(x, '{BOILERPLATE}'))"""

OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
c AS (
    SELECT doc_id, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w,
        length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols,
        list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM d),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - {R.window - 2})) AS i FROM c WHERE len(w) >= {R.window}),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + {R.window - 1}], ' ')) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {R.window})) AS p FROM h WHERE n > 1) GROUP BY doc_id),
f AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(array_to_string(list_filter(lines, lambda x: NOT {_LINE_FAILS}), ''), '[\x20\x09-\x0D]+', '', 'g')) AS kept_chars
    FROM c LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < {R.min_words} OR 100 * n_repeat_words > {R.max_repeat_pct} * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    (NOT base_failed AND 100 * (word_chars - kept_chars) <= {R.max_lost_pct} * word_chars) AS kept
FROM b"""

_TOKENS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = rf"""
WITH bw AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
bg AS (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM bs),
grams AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM bg),
dw AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM grams),
dg AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n),
hits AS (SELECT doc_id, item_id, i, n FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM dg) JOIN grams USING (n, gram)),
spans AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN spans USING (doc_id) LEFT JOIN items USING (doc_id)"""
