"""SQL of DuckDB for the text operators that SQL can express, written from their definitions."""

from __future__ import annotations

from .quality import STOP_WORDS, THRESHOLDS

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
_VALUE = {
    "n_words": "n_words", "mean_word": "word_chars / n", "symbol_ratio": "n_symbols / n", "mark_ratio": "n_marks / n", "stop_ratio": "n_stop / n", "stutter_ratio": "n_stutter / n",
    "repeat_ratio": "n_repeat_words / n", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
}
_GOOD = " AND ".join(f"{_VALUE[s]} {op} {x}" for _, s, op, x in THRESHOLDS)

QUALITY = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(step) AS n_repeat FROM (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS step FROM d) GROUP BY r),
s AS (SELECT w.r, doc_id, len(ws) AS n_words, greatest(len(ws), 1) AS n, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '[!?]')) AS n_marks,
    len(list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+'), lambda x: x IN ({_STOP}))) AS n_stop,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutter
  FROM w LEFT JOIN c ON w.r = c.r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {_GOOD} AS kept
FROM s"""

JACCARD = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT r, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM t WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM p JOIN n x ON a = x.r JOIN n y ON b = y.r WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(r, s) AS (SELECT r, r FROM t UNION SELECT reach.r, e.b FROM reach JOIN e ON reach.s = e.a)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.least AS component_id
FROM t LEFT JOIN n ON t.r = n.r JOIN (SELECT reach.r, min(o.doc_id) AS least FROM reach JOIN t o ON reach.s = o.r GROUP BY reach.r) m ON t.r = m.r"""

#: For pages of the tables' form: one article of headings and paragraphs.
HTML = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|<footer>|$)', 1) AS a FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(a, '</?(?:p|h1)>'), lambda x: replace(replace(regexp_replace(regexp_replace(replace(replace(x, '<b>', ''), '</b>', ''), '<[^<>]*>|<[^<>]*$', ' ', 'g'),
    '&amp(;|$)', '&amp;', 'g'), '&quot;', '"'), '&amp;', '&')) AS b FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(list_transform(b, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), ' ') AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c"""

WARC = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id) AS k, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND k > 1 THEN first END AS refers_to FROM r"""


def _rounds(k: int = 8, rounds: int = 10) -> str:
    """Plain rounds over all vectors and centroids: c0, a0, c1, a1, ... are centroids and assignments."""
    out = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), ''))) - 1 AS j, v AS c FROM v QUALIFY j < {k})"""]
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT r, j, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS d FROM v, c{i}) GROUP BY r)""")
        if i < rounds:
            out.append(f"""s{i} AS MATERIALIZED (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(range(1, 65)) AS i FROM v JOIN a{i} USING (r)) GROUP BY j, i),
c{i + 1} AS MATERIALIZED (SELECT c{i}.j, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{i} GROUP BY j) m ON c{i}.j = m.j)""")
    return ",\n".join(out)


CENTROIDS = f"""WITH {_rounds()}
SELECT vec_id, CAST(a10.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a10.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM v JOIN a10 USING (r) JOIN c10 ON a10.j = c10.j"""

SQL = {"op11_warc": WARC, "op12_yinyang": CENTROIDS, "op2_quality_rules": QUALITY, "op3_ngram_jaccard": JACCARD, "op4_html_extraction": HTML}
