"""SQL for the training-data queries that SQL can express."""

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  AND list_dot_product(a.x, b.x) >= 0.93 * sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))),
r AS (SELECT DISTINCT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS node, count(*) AS n_links FROM e GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.node = vec_id LEFT JOIN n ON n.node = vec_id
"""

DECONTAMINATION = f"""
WITH low AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, i + 1, i + least(10, len(w))), ' ') AS s FROM low, unnest(range(greatest(1, len(w) - 9))) AS t(i) WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS s FROM d, sizes, unnest(range(len(w) - n + 1)) AS t(i)),
hit AS (SELECT doc_id, i, dw.n AS n, item FROM dw JOIN win ON dw.s = win.s AND dw.n = win.n),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), unnest(range(i, i + n)) AS u(p) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""

REPEATS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS n, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT r, n, i, array_slice(b, i + 1, i + 50) AS s FROM d, unnest(range(octet_length(b) - 49)) AS u(i)),
first AS (SELECT s, min(n) AS n FROM s GROUP BY s HAVING min(n) < max(n)),
hit AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50, true) AS fresh FROM s JOIN first USING (s) WHERE s.n > first.n),
run AS (SELECT r, min(i) AS lo, max(i) + 50 AS hi FROM (SELECT r, i, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM hit) GROUP BY r, k),
piece AS (SELECT r, lo AS hi, lag(hi, 1, 0) OVER (PARTITION BY r ORDER BY lo) AS lo FROM run UNION ALL SELECT r, NULL, max(hi) FROM run GROUP BY r),
kept AS (SELECT r, string_agg(hex(array_slice(b, lo + 1, coalesce(hi, octet_length(b)))), '' ORDER BY lo) AS x FROM piece JOIN d USING (r) GROUP BY r),
cut AS (SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM run GROUP BY r)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(x), b)) AS kept_sha256
FROM d LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)
"""

# crc32 by its bit steps: a table of the 256 bytes, then a fold over the bytes of each distinct word
RESAMPLING = f"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
ds AS (SELECT r, unnest(w) AS w FROM d),
bs AS (SELECT unnest({_WORDS.format("coalesce(text, '')")}) AS w FROM benchmark),
word AS (SELECT DISTINCT w FROM (SELECT w FROM ds UNION ALL SELECT w FROM bs)),
bytes AS (SELECT w, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT) AS b FROM word),
bucket AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)])), 4294967295::BIGINT) % 10000 AS k FROM bytes, crc),
n AS (SELECT k, sum(s) AS s, sum(t) AS t FROM (SELECT w, 1 AS s, 0 AS t FROM ds UNION ALL SELECT w, 0, 1 FROM bs) JOIN bucket USING (w) GROUP BY k),
total AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM n),
gain AS (SELECT k, floor(1000 * ln((t::DOUBLE + 1) * (ss::DOUBLE + 10000) / ((s::DOUBLE + 1) * (tt::DOUBLE + 10000))))::BIGINT AS g FROM n, total),
mean AS (SELECT r, sum(g) AS g, count(*) AS c FROM ds JOIN bucket USING (w) JOIN gain USING (k) GROUP BY r),
scored AS (SELECT r, doc_id, len(w) AS n, coalesce(floor(g::DOUBLE / c), 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN mean USING (r)),
s AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, 10 * count(*) OVER () // 100 AS most FROM s WHERE n >= 20)
SELECT doc_id, n::BIGINT AS n_features, weight, score, CASE WHEN rank <= most THEN rank END AS rank FROM s LEFT JOIN ranked USING (r)
"""

_DRAW = "('0x' || substr(h, {0}, 8))::BIGINT"
FILL_IN_MIDDLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, least({_DRAW.format(1)} % (n + 1), {_DRAW.format(9)} % (n + 1)) AS lo, greatest({_DRAW.format(1)} % (n + 1), {_DRAW.format(9)} % (n + 1)) AS hi,
  CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR {_DRAW.format(17)} % 100 >= 90 THEN 'plain' WHEN {_DRAW.format(25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substring(x, 1, lo) AS a, substring(x, lo + 1, hi - lo) AS m, substring(x, hi + 1) AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN lo END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256
FROM p
"""
