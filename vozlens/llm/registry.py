"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from .chat import op4_chat_rotation
from .decontaminate import op10_decontaminate
from .html_text import op5_html_text
from .lm_score import op9_lm_score
from .near_dedup import op2_near_dedup
from .neighbours import op7_nearest
from .packing import op3_packing
from .quality import op6_quality
from .substrings import op8_substring_dedup
from .urls import op1_url_filter
from .urls import oracle as op1_sql

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_near_dedup": op2_near_dedup,
    "op3_packing": op3_packing,
    "op4_chat_rotation": op4_chat_rotation,
    "op5_html_text": op5_html_text,
    "op6_quality": op6_quality,
    "op7_nearest": op7_nearest,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_lm_score": op9_lm_score,
    "op10_decontaminate": op10_decontaminate,
}

OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh
  FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS k
  FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (SELECT x, y FROM c WHERE 100 * k >= 85 * (nx + ny - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.c AS component_id, m.c = s.doc_id AS kept
FROM s JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = s.doc_id
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), p AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS run
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), g AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS run
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)
), m AS (SELECT g.doc_id, g.i, g.n, p.item FROM g JOIN p ON g.n = p.n AND g.run = p.run),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY 1),
s AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(s.n_items, 0) AS n_items,
       sha256(coalesce(s.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""

OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, CAST(floor(turn / 256) AS BIGINT) AS segment, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
r AS (
  SELECT t.conv_id, p.perspective, segment, turn, role, text, role = p.perspective AS own,
         '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = p.perspective THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head,
         text || '<|im_end|>' || chr(10) AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, segment ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM r
)
SELECT conv_id, perspective, segment, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
       string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text) AS text,
       coalesce(string_agg(CAST(CAST(upto - length(body) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(upto AS BIGINT) AS VARCHAR), ',' ORDER BY turn NULLS FIRST, role, text) FILTER (own), '') AS mask
FROM o GROUP BY conv_id, perspective, segment
"""

OP7_SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) AS score
  FROM u q JOIN u c ON len(q.v) = len(c.v) AND q.r <> c.r WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 10
"""

ORACLE_SQL = {
    "op4_chat_rotation": OP4_SQL,
    "op10_decontaminate": OP10_SQL,
    "op2_near_dedup": OP2_SQL,
    "op7_nearest": OP7_SQL,
}


def oracle_sql() -> dict[str, str]:
    """All SQL; that of the url filter holds the fitted weights, so it is made when asked for."""
    return ORACLE_SQL | {"op1_url_filter": op1_sql()}
