"""DuckDB SQL that gives the rows of the queries it names."""

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {1})"
_ALNUM = _WORDS.format("coalesce(text, '')", r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'")

OP3 = rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[CAST(i AS BIGINT):CAST(i AS BIGINT) + least(len(w), 13) - 1], ' ') AS win
       FROM b, UNNEST(range(1, len(w) - least(len(w), 13) + 2)) AS r(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[CAST(i AS BIGINT):CAST(i AS BIGINT) + n - 1], ' ') AS win
       FROM d, lengths, UNNEST(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hit, UNNEST(range(i, i + n)) AS r(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_PLAIN = _WORDS.format("coalesce(text, '')", r"'[^\x20\x09-\x0D]+'")

OP1 = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_PLAIN} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[CAST(i AS BIGINT):CAST(i AS BIGINT) + 3], ' ') AS t
      FROM d, UNNEST(range(1, greatest(len(w) - 3, 1) + 1)) AS r(i) WHERE len(w) > 0),
z AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS met FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE 100 * met >= 85 * (zx.n + zy.n - met)),
l AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM z UNION SELECT reach.a, l.y FROM reach JOIN l ON l.x = reach.b),
least_id AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN least_id USING (doc_id)
"""

OP9 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP8 = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(31) || coalesce(text, '')), role NULLS FIRST, text NULLS FIRST) AS place FROM t),
l AS (SELECT conv_id, place, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS line FROM o),
p AS (SELECT conv_id, place, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY place) AS body, count(*) OVER (PARTITION BY conv_id) AS n FROM l),
f AS (SELECT min(conv_id) AS conv_id, n, body FROM p WHERE place = n GROUP BY n, body)
SELECT f.conv_id, CAST(part AS BIGINT) AS part, n AS n_turns,
       (SELECT string_agg(line, '' ORDER BY place) FROM l WHERE l.conv_id = f.conv_id AND (place - 1) // 256 = part) AS text
FROM f, UNNEST(range(0, (n - 1) // 256 + 1)) AS r(part)
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place = f.n AND p.n > f.n AND p.body = f.body)
"""

#: A space for nulls; the checksum runs over the bits of the key.
OP11 = r"""
WITH RECURSIVE k AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
f AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, 8 * length(key)), lambda j: (CAST(ord(key[CAST(j // 8 + 1 AS BIGINT)]) AS BIGINT) >> CAST(j % 8 AS BIGINT)) & 1)),
           lambda x, b: xor(x >> 1, (xor(x, b) & 1) * 3988292384)), 4294967295) % 20 AS fate FROM k),
r AS (SELECT c, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM f, UNNEST(range(0, CASE WHEN fate = 3 THEN 2 ELSE 1 END)) WHERE fate <> 0),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS p FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY p) > 1 AS again, lead(role[1]) OVER w AS following, lead(true) OVER w AS more, count(*) OVER (PARTITION BY c) AS n
      FROM l WINDOW w AS (PARTITION BY c ORDER BY p)),
g AS MATERIALIZED (SELECT *, role[1] AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_matches(text, '[^\x20\x09-\x0D]') AND again AS duplicate,
             regexp_matches(text, '[^\x20\x09-\x0D]') AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS truncated FROM o),
h AS MATERIALIZED (SELECT *, blank OR duplicate AS gone, CAST(truncated AS BIGINT) AS t FROM g),
v AS (SELECT DISTINCT c, n + 1 AS p, CAST(0 AS BIGINT) AS v0, CAST(4 AS BIGINT) AS v1, CAST(2 AS BIGINT) AS v2, CAST(0 AS BIGINT) AS v3 FROM h
      UNION ALL
      SELECT c, p, least(w0, 2 + w2, 4 + w3), least(w1, 2 + w2, 4 + w3), least(w2, 2 + w3), least(w3, 2 + w2) FROM (
        SELECT h.c, h.p,
          least(3 + v0, CASE WHEN NOT gone THEN least(2 + t + v2, CASE i WHEN 's' THEN t + v1 WHEN 'u' THEN t + v2 WHEN '' THEN t + v0 END) END) AS w0,
          least(3 + v1, CASE WHEN NOT gone THEN least(2 + t + v2, CASE i WHEN 'u' THEN t + v2 WHEN '' THEN t + v1 END) END) AS w1,
          least(3 + v2, CASE WHEN NOT gone THEN least(2 + t + v3, CASE i WHEN 'a' THEN t + v3 WHEN '' THEN t + v2 END) END) AS w2,
          least(3 + v3, CASE WHEN NOT gone THEN least(2 + t + v2, CASE i WHEN 'u' THEN t + v2 WHEN '' THEN t + v3 END) END) AS w3
        FROM v JOIN h ON h.c = v.c AND h.p = v.p - 1)),
z AS MATERIALIZED (SELECT c, p, [v0, v1, v2, v3] AS cost FROM v),
e AS (SELECT z.c, z.p, q, z.cost[CAST(q + 1 AS BIGINT)] AS here, [2, 2, 3, 2][CAST(q + 1 AS BIGINT)] AS put, z.cost, y.cost AS later, role, text, i, t, gone
      FROM z, UNNEST([0, 1, 2, 3]) AS u(q) LEFT JOIN h ON h.c = z.c AND h.p = z.p LEFT JOIN z y ON y.c = z.c AND y.p = z.p + 1),
m AS MATERIALIZED (SELECT c, p, q,
        CASE WHEN here = 3 + later[CAST(q + 1 AS BIGINT)] THEN 'D' WHEN here = 2 + cost[CAST(put + 1 AS BIGINT)] THEN 'I' WHEN later IS NULL THEN NULL
             WHEN i = '' AND here = t + later[CAST(q + 1 AS BIGINT)] THEN 'K' WHEN i = 's' AND q = 0 AND here = t + later[2] THEN 'K'
             WHEN i = 'u' AND q <> 2 AND here = t + later[3] THEN 'K' WHEN i = 'a' AND q = 2 AND here = t + later[4] THEN 'K' ELSE 'R' END AS edit, put, i, role, text FROM e),
a AS (SELECT DISTINCT c, CAST(1 AS BIGINT) AS p, 0 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM h
      UNION ALL
      SELECT a.c, CASE WHEN edit = 'I' THEN a.p ELSE a.p + 1 END,
             CASE WHEN edit = 'D' OR edit = 'K' AND i = '' THEN a.q WHEN edit = 'K' THEN CASE i WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE put END,
             audit || edit,
             CASE edit WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text)
                       ELSE list_append(said, CASE WHEN a.q = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN edit = 'R' THEN text ELSE '' END) END
      FROM a JOIN m ON m.c = a.c AND m.p = a.p AND m.q = a.q WHERE edit IS NOT NULL),
done AS (SELECT a.c, audit, array_to_string(said, chr(10)) AS body FROM a JOIN m ON m.c = a.c AND m.p = a.p AND m.q = a.q WHERE edit IS NULL),
totals AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
             count(*) FILTER (more AND i || following NOT IN ('su', 'ua', 'au')) AS illegal FROM h GROUP BY c)
SELECT k.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(v0, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM k) k LEFT JOIN totals USING (c) LEFT JOIN done USING (c) LEFT JOIN v ON v.c = k.c AND v.p = 1
"""

ORACLE_SQL = {
    "op11_turn_repair": OP11,
    "op8_chat_formatting": OP8,
    "op9_topk": OP9,
    "op1_ngram_jaccard": OP1,
    "op3_decontamination": OP3,
}
