"""DuckDB SQL for the queries of this package that SQL can express."""

_JSON = """'{"arguments":{' || CASE WHEN a.after IS NULL THEN '' ELSE '"after":' || to_json(a.after) || ',' END
 || CASE WHEN a.text IS NULL THEN '' ELSE '"text":' || to_json(a.text) || ',' END || '"turn":' || a.turn || '},"id":' || to_json(a.call_id)
 || ',"level":' || a.level || ',"name":"answer","result":' || coalesce(to_json(r.text), 'null') || '}'"""

TOOL_CALLS = f"""
WITH RECURSIVE asked AS (SELECT DISTINCT conv_id, turn, text FROM conversations
  WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL),
chain AS (
  SELECT a.conv_id, a.turn, a.text, 0 AS level, CAST(NULL AS VARCHAR) AS after FROM asked a
  WHERE NOT EXISTS (SELECT 1 FROM asked b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 2)
  UNION ALL
  SELECT a.conv_id, a.turn, a.text, c.level + 1, c.conv_id || ':' || c.turn FROM asked a
  JOIN chain c ON a.conv_id = c.conv_id AND a.turn = c.turn + 2),
named AS (SELECT *, conv_id || ':' || turn AS call_id FROM chain),
answers AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'assistant' GROUP BY ALL)
SELECT a.conv_id, a.call_id, CASE WHEN r.conv_id IS NULL THEN 'open' ELSE 'linked' END AS status,
 CAST(a.level AS BIGINT) AS level, CAST(0 AS BIGINT) AS n_problems, sha256({_JSON}) AS json_sha256
FROM named a LEFT JOIN answers r ON r.conv_id = a.conv_id AND r.turn = a.turn + 1
UNION ALL
SELECT r.conv_id, r.conv_id || ':' || (r.turn - 1), 'orphan', NULL, 1,
 sha256('{{"id":' || to_json(r.conv_id || ':' || (r.turn - 1)) || ',"result":' || coalesce(to_json(r.text), 'null') || '}}')
FROM answers r WHERE NOT EXISTS (SELECT 1 FROM asked a WHERE a.conv_id = r.conv_id AND a.turn = r.turn - 1)
UNION ALL
SELECT conv_id, conv_id || ':' || turn, 'plain', NULL, 0, sha256('{{"role":' || coalesce(to_json(role), 'null') || ',"text":'
 || coalesce(to_json(text), 'null') || ',"turn":' || coalesce(CAST(turn AS VARCHAR), 'null') || '}}')
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant') OR conv_id IS NULL OR turn IS NULL
"""

DECONTAMINATION = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
sized AS (SELECT *, least(len(w), 13) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS win
    FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS s FROM sized)),
places AS (SELECT r, s, k, array_to_string(w[s:s + k - 1], ' ') AS win
    FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s
          FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hits AS (SELECT p.r, p.s, p.k, v.item_id FROM places p JOIN windows v ON p.win = v.win AND p.k = v.k),
covered AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + k - 1)) AS place FROM hits) GROUP BY r),
listed AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, min(struct_pack(label := CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END,
    q := list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))))) AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 GROUP BY vec_id),
n AS (SELECT vec_id, r.label AS label, r.q AS q FROM v),
scored AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
    CAST(list_sum(list_transform(range(1, 1 + least(len(a.q), len(b.q))), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM n a JOIN n b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score,
 s.score AS negative_score FROM p JOIN scored s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""

CAPTURES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
h AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS holder FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(hex, CAST(1 + 5 * i AS INTEGER), 5) AS BIGINT)) AS part FROM h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(part, lambda x: array_to_string(list_transform([32768, 1024, 32, 1],
   lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (x // d) % 32 AS INTEGER), 1)), '')), '') AS payload_digest,
 CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> holder THEN holder END AS refers_to FROM b
"""

ORACLE: dict[str, str] = {"op4_decontamination": DECONTAMINATION, "op8_tool_calls": TOOL_CALLS,
                           "op11_threshold": HARD_NEGATIVES, "op12_capture_index": CAPTURES}
