"""SQL of the queries that SQL can express."""

_SEP = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"

QUALITY = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '{_SEP}'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_SEP}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, (n_symbols * 1000) // greatest(n_words, 1) AS symbol, (n_dup_lines * 1000) // greatest(n_lines, 1) AS dup_line,
  (n_repeat_words * 1000) // greatest(n_words, 1) AS repeat_, (word_chars * 100) // greatest(n_words, 1) AS len_ FROM m),
v AS (SELECT lang, source, name, CASE name WHEN 'symbol' THEN symbol WHEN 'dup_line' THEN dup_line WHEN 'repeat' THEN repeat_ ELSE len_ END AS v FROM b, (VALUES ('symbol'), ('dup_line'), ('repeat'), ('length')) k(name) WHERE NOT base_failed),
h AS (SELECT lang, source, name, greatest(length(bin(v)) - 5, 0) * 16 + (v >> greatest(length(bin(v)) - 5, 0)) AS b, count(*) AS c FROM v GROUP BY ALL),
l3 AS (SELECT 0 AS lev, lang, source, name, b, c FROM h UNION ALL SELECT 1, lang, NULL, name, b, sum(c) FROM h GROUP BY lang, name, b UNION ALL SELECT 2, NULL, NULL, name, b, sum(c) FROM h GROUP BY name, b),
q0 AS (SELECT *, sum(c) OVER (PARTITION BY lev, lang, source, name) AS n, sum(c) OVER (PARTITION BY lev, lang, source, name ORDER BY b) AS cum, greatest(b // 16 - 1, 0) AS sh FROM l3),
q AS (SELECT lev, lang, source, name, n, min(CASE WHEN cum * 4 >= n THEN ((b - sh * 16 + 1) << sh) - 1 END) AS q1, min(CASE WHEN cum * 4 >= n * 3 THEN ((b - sh * 16 + 1) << sh) - 1 END) AS q3 FROM q0 GROUP BY lev, lang, source, name, n),
f AS (SELECT a.lang, a.source, a.name, CASE WHEN a.n >= 100 THEN a.q1 WHEN x.n >= 100 THEN x.q1 ELSE y.q1 END AS q1, CASE WHEN a.n >= 100 THEN a.q3 WHEN x.n >= 100 THEN x.q3 ELSE y.q3 END AS q3,
  CASE a.name WHEN 'symbol' THEN 50 WHEN 'dup_line' THEN 100 WHEN 'repeat' THEN 30 ELSE 50 END AS least_
  FROM q a JOIN q x ON x.lev = 1 AND a.lang IS NOT DISTINCT FROM x.lang AND a.name = x.name JOIN q y ON y.lev = 2 AND a.name = y.name WHERE a.lev = 0),
t AS (SELECT lang, source, name, q1 - 3 * greatest(q3 - q1, least_) AS lo, greatest(q3 + 3 * greatest(q3 - q1, least_), CASE name WHEN 'repeat' THEN 200 WHEN 'dup_line' THEN 500 ELSE 0 END) AS hi FROM f)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(symbol > ts.hi OR dup_line > td.hi OR repeat_ > tr.hi OR (n_words >= 50 AND (len_ > tl.hi OR len_ < tl.lo)), false) AS kept
FROM b LEFT JOIN t ts ON ts.name = 'symbol' AND ts.lang IS NOT DISTINCT FROM b.lang AND ts.source IS NOT DISTINCT FROM b.source
LEFT JOIN t td ON td.name = 'dup_line' AND td.lang IS NOT DISTINCT FROM b.lang AND td.source IS NOT DISTINCT FROM b.source
LEFT JOIN t tr ON tr.name = 'repeat' AND tr.lang IS NOT DISTINCT FROM b.lang AND tr.source IS NOT DISTINCT FROM b.source
LEFT JOIN t tl ON tl.name = 'length' AND tl.lang IS NOT DISTINCT FROM b.lang AND tl.source IS NOT DISTINCT FROM b.source"""

WARC = "SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS n_bytes, sha256(html) AS sha256, page_id % 97 <> 13 AS intact FROM pages"

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SEP}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), c(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.x, u.b FROM c JOIN u ON u.a = c.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM c GROUP BY x) m ON m.x = d.doc_id"""


def urls(rules: list[tuple], unwanted: tuple[str, ...]) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    words = ", ".join(f"'{w}'" for w in unwanted)
    return f"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r(rh, rp, rv) AS (VALUES {values}),
f AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(rv, CASE WHEN list_has_any(string_split_regex(host, '[.-]'), [{words}]) THEN 'block' ELSE 'allow' END) AS verdict FROM h LEFT JOIN f ON h.page_id = f.page_id"""
