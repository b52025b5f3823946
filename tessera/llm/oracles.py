"""SQL that gives the rows of the registered queries that SQL can express."""

from __future__ import annotations

from . import ego, lm, packing

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first FROM p)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest, 'ok' AS status,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

OP3 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, list_transform(e, lambda x: x / norm) AS e FROM n WHERE norm > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= {ego.THRESHOLD}),
walk(node, low) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, walk.low FROM walk JOIN l ON l.a = walk.node AND walk.low < l.b),
c AS (SELECT node, min(low) AS component_id FROM walk GROUP BY node),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.node = vec_id LEFT JOIN k ON k.a = vec_id
"""

# crc32 of ASCII text; the table of the polynomial follows from its rule
_CRC = """
poly AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS n)))"""
_FOLD = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), "
    "lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 5"
)

#: A space stands for the end of a text, two for its start; neither is a word.
OP4 = f"""
WITH {_CRC.strip()},
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_FOLD}, 0) = 1 AS held_out,
         list_append({_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, ' ') AS ws
  FROM documents, poly),
x AS (SELECT r, held_out, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (
  SELECT *, lag(w, 1, '  ') OVER (PARTITION BY r ORDER BY i) AS v,
         CASE WHEN i > 1 THEN lag(w, 2, '  ') OVER (PARTITION BY r ORDER BY i) END AS u
  FROM x),
c1 AS (SELECT w, count(*) AS c FROM g WHERE NOT held_out GROUP BY w),
c2 AS (SELECT v, w, count(*) AS c FROM g WHERE NOT held_out GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS c FROM g WHERE NOT held_out AND u IS NOT NULL GROUP BY u, v, w),
k AS (SELECT w, c FROM c1 UNION ALL SELECT '  ', (SELECT count(*) FROM d WHERE NOT held_out)),
s AS (SELECT sum(c)::BIGINT AS n, count(*) AS types FROM c1),
a AS (
  SELECT g.r, g.i, coalesce(c1.c, 0) AS n1, coalesce(c2.c, 0) AS n2, coalesce(c3.c, 0) AS n3, coalesce(k.c, 0) AS m1, coalesce(m.c, 0) AS m2, g.u IS NOT NULL AS deep
  FROM g LEFT JOIN c1 ON c1.w = g.w LEFT JOIN c2 ON c2.v = g.v AND c2.w = g.w LEFT JOIN c3 ON c3.u = g.u AND c3.v = g.v AND c3.w = g.w
  LEFT JOIN k ON k.w = g.v LEFT JOIN c2 m ON m.v = g.u AND m.w = g.v),
p1 AS (SELECT *, (n1 + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (types + 1)) AS p1 FROM a, s),
p2 AS (SELECT *, (n2 + {lm.PRIORS[0]}::DOUBLE * p1) / (m1 + {lm.PRIORS[0]}::DOUBLE) AS p2 FROM p1),
p3 AS (SELECT *, CASE WHEN deep THEN (n3 + {lm.PRIORS[1]}::DOUBLE * p2) / (m2 + {lm.PRIORS[1]}::DOUBLE) ELSE p2 END AS p3 FROM p2),
t AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (n1 > 0) AS n_known, sum(log10(p1)) AS base_score, sum(log10(p3)) AS score FROM p3 GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, base_score, score FROM d JOIN t USING (r), s
"""

_SAID = r"\### Assistant: </turn> ok"
OP9 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'),
l AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
         length(regexp_replace(role, '[\\\\#:<]', 'xx', 'g')) + length(regexp_replace(text, '[\\\\#:<]', 'xx', 'g')) + 14 AS shown
  FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(length(loss))::BIGINT AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256, sum(shown)::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""

OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(ws[i : i + 12], ' ') AS g FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
low AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
hit AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS j FROM win JOIN low USING (g) WHERE first < doc_id),
word AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS j FROM d),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY j) AS text FROM word ANTI JOIN hit USING (r, j) GROUP BY r),
gone AS (SELECT r, count(*) AS n FROM hit GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN gone USING (r)
"""

#: ``layer`` holds the least padding with at most b buckets up to each length and the length that the last bucket follows
#: (-1: one bucket fewer does); ``path`` goes back through it.
OP7 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS n_tokens,
         md5(coalesce(doc_id::VARCHAR, 'null') || ':pack:' || md5(coalesce(text, ''))) AS rank
  FROM documents),
l AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY len) AS j, len, (sum(n) OVER (ORDER BY len))::BIGINT AS c, (sum(n * len) OVER (ORDER BY len))::BIGINT AS t
  FROM (SELECT n_tokens AS len, count(*) AS n FROM d GROUP BY 1)),
m AS (SELECT count(*) AS m FROM l),
layer(b, j, cost, arg) AS (
  SELECT 1, j, len * c - t, 0::BIGINT FROM l
  UNION ALL
  SELECT b + 1, j, best.v, best.i FROM (
    SELECT b, j, arg_min({{'v': v, 'i': i}}, {{'v': v, 'i': i}}) AS best FROM (
      SELECT a.b, x.j, CASE WHEN x.j = a.j THEN a.cost ELSE a.cost + x.len * (x.c - y.c) - (x.t - y.t) END AS v, CASE WHEN x.j = a.j THEN -1 ELSE a.j END AS i
      FROM layer a JOIN l y ON y.j = a.j JOIN l x ON x.j >= a.j WHERE a.b < least({packing.N_BUCKETS}, (SELECT m FROM m))) GROUP BY b, j)),
path(b, j) AS (
  SELECT least({packing.N_BUCKETS}, m), m FROM m
  UNION ALL SELECT p.b - 1, CASE WHEN y.arg = -1 THEN p.j ELSE y.arg END FROM path p JOIN layer y ON y.b = p.b AND y.j = p.j WHERE p.b > 1),
ends AS (SELECT list(len ORDER BY len) AS e FROM l WHERE j IN (SELECT j FROM path)),
placed AS (SELECT d.*, len(list_filter(e, lambda x: x < n_tokens)) AS bucket, list_filter(e, lambda x: x >= n_tokens)[1] AS bucket_tokens FROM d, ends),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY rank, doc_id, n_tokens) - 1 AS k, count(*) OVER (PARTITION BY bucket) AS n,
         greatest(1, {packing.TOKEN_BUDGET} // greatest(bucket_tokens, 1)) AS per FROM placed)
SELECT doc_id, n_tokens, bucket::INTEGER AS bucket, bucket_tokens, k // per AS batch, k % per AS slot, least(per, n - (k // per) * per) AS batch_rows FROM ranked
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS x,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u
  FROM documents),
h AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
