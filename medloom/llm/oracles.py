"""SQL of the corpus queries that SQL can express."""

from __future__ import annotations

EXACT = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(sum(n) OVER w AS BIGINT) AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t, count(*) AS n FROM documents GROUP BY ALL)
WINDOW w AS (PARTITION BY t)
"""

# CRC-32 by its rule: eight shifts of the reflected polynomial 0xEDB88320 for each table entry, one entry per byte.
CRC = """bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i)),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits),
crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(t[xor(c % 256, b) + 1], c // 256)), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT w FROM words), crc_table)"""

IMPORTANCE = rf"""
WITH texts AS (SELECT 0 AS side, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 1, NULL, coalesce(text, '') FROM benchmark),
words AS (SELECT side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
{CRC},
features AS (SELECT side, doc_id, bucket, count(*) AS n FROM words JOIN crc USING (w) GROUP BY ALL),
per AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0)::DOUBLE AS t FROM features GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM per) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM per) + 10000))))::BIGINT AS g FROM per),
weights AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM features JOIN gain USING (bucket) WHERE side = 0 GROUP BY 1),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN weights USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""

NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 5
"""

ORACLES = {"op9_exact_dedup": EXACT, "op12_importance_resampling": IMPORTANCE, "op13_hard_negatives": NEGATIVES}
