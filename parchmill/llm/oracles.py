"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from parchmill.llm.decontaminate import N, SHARE
from parchmill.llm.jaccard_forest import SHINGLE, THRESHOLD
from parchmill.llm.line_dedup import MIN_PAGES, RATIO
from parchmill.llm.shards import OVERHEAD, SHARDS

OP2 = rf"""
WITH tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
bench AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), {N}) AS size, array_to_string(w[i:i + least(len(w), {N}) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - {N} + 1, 1))) AS i FROM bench WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, size, w, unnest(generate_series(1, len(w) - size + 1)) AS i FROM tokens, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, size, i, item FROM grams JOIN windows USING (size, gram)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM tokens LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(CAST(encode(html) AS BLOB)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id <> first THEN first END AS refers_to
FROM f
"""

_BLANKS = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
OP9_CLEAN = f"""
d AS (SELECT *, coalesce(source, '') AS host, coalesce(text, '') AS body FROM {{docs}}),
totals AS (SELECT host, count(DISTINCT body) AS total FROM d GROUP BY host),
pages AS (SELECT DISTINCT host, body FROM d),
page_lines AS (SELECT DISTINCT host, body, trim(line, {_BLANKS}) AS line FROM (SELECT host, body, unnest(string_split(body, chr(10))) AS line FROM pages)),
boiler AS (SELECT host, line FROM page_lines JOIN totals USING (host) WHERE line <> '' GROUP BY host, line, total HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO} * total),
marked AS (
  SELECT host, body, i, raw, b.line IS NOT NULL AS drop
  FROM (SELECT host, body, i, string_split(body, chr(10))[i] AS raw FROM (SELECT host, body, unnest(generate_series(1, len(string_split(body, chr(10))))) AS i FROM pages))
  LEFT JOIN (SELECT host AS bhost, line FROM boiler) b ON bhost = host AND b.line = trim(raw, {_BLANKS})),
cleaned AS (SELECT host, body, count(*) AS n_lines, count(*) FILTER (drop) AS n_dropped, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT drop), '') AS new_text FROM marked GROUP BY host, body)"""
OP9 = f"""
WITH {OP9_CLEAN.format(docs="documents")}
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE n_lines END AS n_lines, n_dropped, CASE WHEN text IS NOT NULL THEN length(new_text) END AS n_chars, CASE WHEN text IS NOT NULL THEN sha256(new_text) END AS text_sha256
FROM d JOIN cleaned USING (host, body)
"""

_OP4_SETS = rf"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{{{80}}}}-\x{{{{10FFFF}}}}]+') AS w FROM {{docs}}),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(generate_series(1, greatest(len(w) - {SHINGLE} + 1, 1)), lambda i: hash(array_to_string(w[i:i + {SHINGLE} - 1], ' '))))) AS s FROM w WHERE len(w) > 0),
sets AS (SELECT s, min(doc_id) AS rep, count(*) AS copies FROM s GROUP BY s),
grams AS (SELECT rep, copies, len(s) AS n, unnest(s) AS g FROM sets),
meets AS (SELECT a.rep AS x, b.rep AS y, b.copies, a.n AS n, b.n AS m, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL),
linked AS (SELECT x, y, copies FROM meets WHERE c >= {THRESHOLD} * (n + m - c) - 1e-9),
reach AS (SELECT x, x AS y FROM (SELECT DISTINCT x FROM linked) UNION SELECT r.x, l.y FROM reach r JOIN linked l ON l.x = r.y),
roots AS (SELECT x, min(y) AS root FROM reach GROUP BY x),
counts AS (SELECT x, sum(copies) AS links FROM linked GROUP BY x)"""
OP4 = f"""
WITH RECURSIVE {_OP4_SETS.format(docs="documents")}
SELECT doc_id, coalesce(root, rep, doc_id) AS class_id, coalesce(rep, doc_id) AS copy_id, CAST(coalesce(links, 0) + coalesce(copies, 1) - 1 AS BIGINT) AS n_links
FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN sets USING (s) LEFT JOIN roots ON roots.x = rep LEFT JOIN counts ON counts.x = rep
"""

# crc32 by its table of 256 entries, byte by byte; shards by prefix sums over the whole table.
OP5 = f"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(CAST(k AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS tab
  FROM range(256) AS r(k)),
d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
sized AS (
  SELECT doc_id, octet_length(encode(body)) + {OVERHEAD} AS size,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, crc_table),
placed AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start, CAST(sum(size) OVER () AS BIGINT) AS total
  FROM sized),
cut AS (SELECT *, CAST(least({SHARDS - 1}, ((2 * start + size) * {SHARDS}) // (2 * total)) AS INTEGER) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, start
FROM cut
"""

ORACLES = {"op5_byte_shards": OP5, "op4_jaccard_forest": OP4, "op9_line_dedup": OP9, "op2_decontamination": OP2, "op3_warc": OP3}
