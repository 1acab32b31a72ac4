"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from .decontaminate import PERCENT, WINDOW
from .lines import MIN_CHARS

_LOW = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"
_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ALNUM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP3 = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_ALNUM.format(_LOW)} AS w FROM benchmark),
  windows AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS passage FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM items WHERE len(w) > 0)),
  docs AS (SELECT doc_id, {_ALNUM.format(_LOW)} AS w FROM documents),
  hits AS (SELECT d.doc_id, d.i, d.n, windows.item FROM (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM docs, (SELECT DISTINCT n FROM windows)) d JOIN windows ON windows.n = d.n AND windows.passage = array_to_string(d.w[d.i : d.i + d.n - 1], ' ')),
  cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
  found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 100 * coalesce(n_hit, 0) >= {PERCENT} * len(d.w) AS contaminated
FROM docs d LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP6 = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
  lines AS (SELECT doc_id, line, i, translate(trim(line, {_BLANK}), '{ascii_uppercase}', '{ascii_lowercase}') AS k FROM (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS i FROM parts)),
  firsts AS (SELECT k, min(doc_id) AS f FROM lines WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) > 1),
  marked AS (SELECT doc_id, line, i, coalesce(doc_id <> f, false) AS gone FROM lines LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""

OP8 = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_SPACED.format(_LOW)} AS w FROM documents),
  sets AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM docs WHERE len(w) > 0)),
  sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
  common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT r.a AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM reach r LEFT JOIN sizes ON sizes.doc_id = r.a GROUP BY r.a
"""

_BITS = "list_reduce(list_transform(string_split(sha1(h), ''), lambda c: lpad(bin(('0x' || c)::INT), 4, '0')), lambda a, b: a || b)"
OP10 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
  d AS (SELECT page_id, strlen(h) AS n, {_BITS} AS bits, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (list_reduce(list_transform(range(0, 5), lambda j: substr(bits, (i * 5 + j + 1)::BIGINT, 1)::INT * (2 ** (4 - j))::INT), lambda a, b: a + b) + 1)::BIGINT, 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM d
"""


# The tables' pages hold one article each, whose markup is blocks and <b>, and few character references.
OP7 = r"""
WITH story AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS s FROM pages),
  plain AS (SELECT page_id, url, regexp_replace(regexp_replace(s, '<(br|/?p|/?h1)>', ' ', 'g'), '</?b>', '', 'g') AS s FROM story),
  read AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(s, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;?', '&', 'g') AS s FROM plain),
  said AS (SELECT page_id, url, trim(regexp_replace(s, '[\s\v\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS text FROM read)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM said
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3, "op6_line_dedup": OP6, "op7_html_text": OP7, "op8_jaccard_join": OP8, "op10_warc": OP10}
