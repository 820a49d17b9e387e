"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from strata.llm.quality_rules import STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"

OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
hit AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (k) WHERE m < doc_id)),
gone AS (SELECT doc_id, list(p) AS g FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN g IS NULL THEN array_to_string(w, ' ') ELSE
    array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(g, p)), lambda p: w[p]), ' ') END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)"""

_MARK = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_ASCII.format("coalesce(text, '')")}, '{_MARK}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_ASCII.format("coalesce(text, '')")}, '{_MARK}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
  SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
m AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, k)),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_ASCII.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS k FROM (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.c + q.c - shared)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT d.doc_id AS doc_id, coalesce(n.c, 0) AS n_shingles, m AS component_id, m = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = d.doc_id"""

_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c, 0) AS n_repeat_words, len(l) AS n_lines,
  len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS stops, length(t) - length(replace(t, '!', '')) AS bangs,
  len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS bullets,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS ellipses
  FROM d LEFT JOIN rep USING (doc_id)), f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 25 AND n_symbols / n_words <= 0.1 AND stops / n_words >= 0.01
  AND bangs / n_words <= 0.3 AND n_dup_lines / n_lines <= 0.7 AND bullets / n_lines <= 0.9 AND ellipses / n_lines <= 0.3 AS kept
FROM f"""

OP9 = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, lower(hex(b)) AS x, octet_length(b) AS n FROM d),
win AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS k FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS i FROM h)),
first AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win),
edges AS (SELECT doc_id, i, coalesce(i > 100 + lag(i) OVER w, true) AS fresh FROM first WHERE r > 1 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM (
  SELECT doc_id, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM edges) GROUP BY doc_id, g),
cut AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(z - a) AS BIGINT) AS n_removed, list(a ORDER BY a) AS s, list(z ORDER BY a) AS e FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN s IS NULL THEN unhex(x) ELSE unhex(array_to_string(list_transform(range(0, len(s) + 1),
    lambda j: substr(x, 2 * CASE WHEN j = 0 THEN 0 ELSE e[j] END + 1, 2 * (CASE WHEN j = len(s) THEN n ELSE s[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE e[j] END))), '')) END) AS kept_sha256
FROM h LEFT JOIN cut USING (doc_id)"""

OP10 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, min(page_id) AS f FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN f IS NULL OR f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f <> page_id THEN f END AS refers_to FROM p LEFT JOIN g ON g.d = p.d"""

ORACLE = {
    "op3_substrings": OP3,
    "op4_winnowing": OP4,
    "op6_minhash": OP6,
    "op8_quality_rules": OP8,
    "op9_suffixes": OP9,
    "op10_warc": OP10,
}
