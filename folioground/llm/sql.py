"""DuckDB forms of the queries that SQL can express, written apart from the operators."""

#: Brute force: every pair that shares a shingle, counted by a join on shingles.
OP2_NGRAM_JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s,
         least(len(w), 5) AS k FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(v) FROM reach r WHERE r.u = d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
"""

#: All pairs; the operator finds nearly all links (recall is measured in the tests).
OP4_SPHERICAL_CAPS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE u = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN least ON u = e.vec_id
"""

#: The published loop with 128-bit integers; the checksum by its table, made from its rule.
OP6_JUMP_SHARDING = """
WITH RECURSIVE bits(i, k, x) AS (
  SELECT i, 0, i FROM range(256) t(i) UNION ALL
  SELECT i, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(x ORDER BY i) AS tab FROM bits WHERE k = 8),
jumps(doc_id, b, j, key) AS (
  SELECT DISTINCT doc_id, -1::BIGINT, 0::BIGINT, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id::HUGEINT END FROM documents
  UNION ALL
  SELECT doc_id, j, floor((j + 1) * (2147483648.0::DOUBLE / ((((key % 4294967296) * 2862933555777941757 + ((key // 4294967296) * 2862933555777941757 % 4294967296) * 4294967296 + 1) % 18446744073709551616 // 8589934592) + 1)::DOUBLE))::BIGINT,
         ((key % 4294967296) * 2862933555777941757 + ((key // 4294967296) * 2862933555777941757 % 4294967296) * 4294967296 + 1) % 18446744073709551616
  FROM jumps WHERE j < 25
), shards AS (SELECT doc_id, max(b) FILTER (b < 24) AS shard, max(b) AS grown FROM (SELECT doc_id, b FROM jumps WHERE b >= 0) GROUP BY doc_id),
bytes AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (SELECT doc_id, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM bytes, crc)
SELECT s.doc_id, n + 8 AS size, crc AS text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY s.doc_id) - 1 AS slot, grown::INT AS grown_shard
FROM sums s JOIN shards USING (doc_id)
"""

OP7_REVISITS = r"""
WITH records AS (
  SELECT page_id AS id, page_id AS t, coalesce(length(html), 0) AS size, page_id // 40 AS version, md5(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS bytes,
         regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/]*)/', 1)), '^www\.', '') || rtrim('/' || regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1) || '/', '/') AS url FROM pages
), tagged AS (
  SELECT *, CASE WHEN size % 7 < 5 THEN '"v' || version || '"' END AS tag, CASE WHEN size % 7 < 5 AND size % 2 = 0 THEN 'W/' ELSE '' END AS weak, CASE WHEN size % 7 < 6 THEN version * 40 END AS modified FROM records
), met AS (
  SELECT v.*, r.id AS rid, r.tag AS rtag, r.modified AS rmodified, r.digest AS rdigest, r.bytes AS rbytes
  FROM (SELECT * FROM tagged WHERE size % 3 = 0) v ASOF LEFT JOIN (SELECT * FROM tagged WHERE size % 3 <> 0) r ON v.url = r.url AND v.t > r.t
), judged AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'no_earlier' WHEN tag IS NULL AND modified IS NULL THEN 'no_validator'
    WHEN CASE WHEN tag IS NOT NULL THEN coalesce(tag = rtag, false) ELSE coalesce(modified = rmodified, false) END THEN 'resolved' ELSE 'validator_mismatch' END AS outcome FROM met
)
SELECT id AS record_id, url AS canonical_url, outcome, CASE WHEN outcome = 'resolved' THEN rid END AS refers_to, CASE WHEN outcome = 'resolved' THEN rdigest END AS digest, CASE WHEN outcome = 'resolved' THEN 200 END AS status,
       CASE WHEN outcome = 'resolved' THEN 'content-length: ' || rbytes || '; content-type: text/html; date: ' || id || '; etag: ' || coalesce(weak || tag, '') END AS headers
FROM judged
"""

#: All inner products of the integer vectors.
OP11_PIVOT_TOP_K = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding::DOUBLE[], lambda c: floor(256 * c)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scores AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scores) WHERE rank <= 5
"""

#: Postings of all documents, joined with the items' terms.
OP13_RANKED_SEARCH = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents
), tfs AS (SELECT doc_id, t, count(*) AS tf FROM terms GROUP BY 1, 2),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY 1),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
dfs AS (SELECT t, count(*) AS df FROM tfs GROUP BY 1),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), weights AS (SELECT item_id, t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM asked JOIN dfs USING (t), total),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM weights JOIN tfs USING (t) JOIN sizes USING (doc_id), total GROUP BY 1, 2
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""
