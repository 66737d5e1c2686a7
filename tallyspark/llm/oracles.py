"""The subpackage's queries as DuckDB SQL, where SQL can express them in reasonable time on whole tables."""

SQL: dict[str, str] = {}

SQL["op10_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM (SELECT *, least(10, len(w)) AS m FROM b) WHERE m > 0)),
lengths AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths)),
hit AS (SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (m, win)),
words AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS at FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL["op6_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, strlen(payload) AS payload_bytes, hex,
    list_aggregate(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4)) AS BIGINT) % 32 + 1, 1)),
      'string_agg', '') AS payload_digest
  FROM p),
first AS (SELECT hex, payload_bytes, max(page_id) AS top FROM d GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d JOIN first USING (hex, payload_bytes)
"""

#: Marks and escapes of the template, for formatted_chars: no text of these tables but conversation -1 needs an escape.
SQL["op5_chat"] = """
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '') AS loss,
    sum(length(text) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 END
      + CASE WHEN conv_id = -1 THEN 3 ELSE 0 END) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""

SQL["op1_cap_filters"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT vec_id, vec_id AS r FROM embeddings
  UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id)
SELECT c.vec_id, count(links.b) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN links ON links.a = c.vec_id GROUP BY c.vec_id, component_id
"""

SQL["op7_group_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b
    ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT reach.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id
"""

SQL["op8_mixing"] = r"""
WITH d AS (
  SELECT doc_id, 'domain' || (coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '(\d+)$', 1) AS BIGINT), 0) % 4) AS domain,
    coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source, lang AS own_lang, source AS own_source,
    len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x{0B}\f\r]+')) AS tokens
  FROM documents),
leaf AS (
  SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS supply, CAST(3 * sum(tokens) AS BIGINT) AS cap,
    CASE domain WHEN 'domain0' THEN 30 WHEN 'domain1' THEN 30 WHEN 'domain2' THEN 20 WHEN 'domain3' THEN 20 ELSE 1 END AS wd,
    CASE lang WHEN 'en' THEN 40 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 WHEN 'es' THEN 20 ELSE 1 END AS wl
  FROM d GROUP BY domain, lang, source),
-- A level's budgets: children in order of capacity by weight; the first ones are full, the others share what is left.
c1 AS (
  SELECT domain, wd AS w, CAST(sum(cap) AS BIGINT) AS cap, least((SELECT CAST(sum(supply) AS BIGINT) * 120 // 100 FROM leaf),
    (SELECT CAST(sum(cap) AS BIGINT) FROM leaf)) AS b FROM leaf GROUP BY domain, wd),
f1 AS (
  SELECT *, b - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM c1 WINDOW o AS (ORDER BY cap / w, domain)),
g1 AS (SELECT *, cap * ws <= w * rest AS is_full FROM f1),
p1 AS (
  SELECT *, CASE WHEN is_full THEN cap ELSE w * coalesce(max(rest) FILTER (NOT is_full) OVER (), 0)
    // coalesce(max(ws) FILTER (NOT is_full) OVER (), 1) END AS part FROM g1),
b1 AS (
  SELECT domain, part + CASE WHEN NOT is_full AND coalesce(sum(CASE WHEN is_full THEN 0 ELSE 1 END) OVER (
    ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < b - sum(part) OVER () THEN 1 ELSE 0 END
    AS b FROM p1),
c2 AS (
  SELECT domain, lang, wl AS w, CAST(sum(cap) AS BIGINT) AS cap, any_value(b1.b) AS b
  FROM leaf JOIN b1 USING (domain) GROUP BY domain, lang, wl),
f2 AS (
  SELECT *, b - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM c2 WINDOW o AS (PARTITION BY domain ORDER BY cap / w, lang)),
g2 AS (SELECT *, cap * ws <= w * rest AS is_full FROM f2),
p2 AS (
  SELECT *, CASE WHEN is_full THEN cap ELSE w * coalesce(max(rest) FILTER (NOT is_full) OVER (PARTITION BY domain), 0)
    // coalesce(max(ws) FILTER (NOT is_full) OVER (PARTITION BY domain), 1) END AS part FROM g2),
b2 AS (
  SELECT domain, lang, part + CASE WHEN NOT is_full AND coalesce(sum(CASE WHEN is_full THEN 0 ELSE 1 END) OVER (
    PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    < b - sum(part) OVER (PARTITION BY domain) THEN 1 ELSE 0 END AS b FROM p2),
c3 AS (SELECT domain, lang, source, supply, 1 AS w, cap, b2.b FROM leaf JOIN b2 USING (domain, lang)),
f3 AS (
  SELECT *, b - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM c3 WINDOW o AS (PARTITION BY domain, lang ORDER BY cap / w, source)),
g3 AS (SELECT *, cap * ws <= w * rest AS is_full FROM f3),
p3 AS (
  SELECT *, CASE WHEN is_full THEN cap ELSE w * coalesce(max(rest) FILTER (NOT is_full) OVER (PARTITION BY domain, lang), 0)
    // coalesce(max(ws) FILTER (NOT is_full) OVER (PARTITION BY domain, lang), 1) END AS part FROM g3),
b3 AS (
  SELECT domain, lang, source, supply, part + CASE WHEN NOT is_full AND coalesce(sum(CASE WHEN is_full THEN 0 ELSE 1 END) OVER (
    PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    < b - sum(part) OVER (PARTITION BY domain, lang) THEN 1 ELSE 0 END AS b FROM p3),
k AS (
  SELECT d.*, CASE WHEN supply > 0 THEN b // supply ELSE 0 END AS whole, b - CASE WHEN supply > 0 THEN b // supply ELSE 0 END * supply
    AS rest FROM d JOIN b3 USING (domain, lang, source)),
u AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY substr(md5('5|' || whole || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15),
      coalesce(CAST(doc_id AS VARCHAR), '')) AS used FROM k)
SELECT doc_id, domain, own_lang AS lang, own_source AS source, tokens,
  unnest(range(1, CAST(least(whole + CASE WHEN used <= rest THEN 1 ELSE 0 END, 3) AS BIGINT) + 1)) AS epoch
FROM u
"""

SQL["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
  AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
