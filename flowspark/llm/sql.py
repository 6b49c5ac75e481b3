"""DuckDB SQL that states the results of those operators which SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JACCARD_JOIN = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), tokens AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (min(a.n) + min(b.n) - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.s
"""

# a bucket (prefix) above the limit splits on one more bit; every row ends in the first that fits
EXTENDIBLE_SHARDS = """
WITH RECURSIVE hashed AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), 'null'), coalesce(md5(text), 'null'))) AS digest
  FROM documents
), rows AS (
  SELECT doc_id, n_bytes, lpad(bin(CAST('0x' || substr(digest, 1, 15) AS BIGINT)), 60, '0') AS bits FROM hashed
), buckets AS (
  SELECT doc_id, n_bytes, bits, 0 AS depth, CAST(sum(n_bytes) OVER () AS BIGINT) AS bytes FROM rows
  UNION ALL
  SELECT doc_id, n_bytes, bits, depth + 1,
    CAST(sum(n_bytes) OVER (PARTITION BY substr(bits, 1, depth + 1)) AS BIGINT)
  FROM buckets WHERE bytes > 1048576 AND depth < 60
)
SELECT doc_id, n_bytes, substr(bits, 1, depth) AS shard, CAST(depth AS INTEGER) AS depth, CAST(0 AS BIGINT) AS page, bytes AS shard_bytes
FROM buckets WHERE bytes <= 1048576 OR depth = 60
"""

# retrieval only prunes: the verified overlap of all pairs that share a shingle gives the same rows
DECONTAMINATE = rf"""
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') FROM benchmark
), shingles AS (
  SELECT kind, id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS s
  FROM words
), halves AS (
  SELECT id, 0 AS half, unnest(list_distinct(s[1:(len(s) + 1) // 2])) AS token FROM shingles WHERE kind = 1
  UNION ALL
  SELECT id, 1, unnest(list_distinct(CASE WHEN len(s) > 1 THEN s[(len(s) + 1) // 2 + 1:] ELSE s END)) FROM shingles WHERE kind = 1
), sizes AS (
  SELECT id, count(*) FILTER (half = 0) AS q, count(*) FILTER (half = 1) AS a FROM halves GROUP BY id
), held AS (
  SELECT DISTINCT id, unnest(s) AS token FROM shingles WHERE kind = 0
), hits AS (
  SELECT d.id AS doc_id, h.id AS item_id, count(*) FILTER (half = 0) AS q, count(*) FILTER (half = 1) AS a
  FROM held d JOIN halves h USING (token) GROUP BY d.id, h.id
), leaked AS (
  SELECT doc_id, item_id, (h.q + h.a) / (s.q + s.a) AS overlap FROM hits h JOIN sizes s ON s.id = h.item_id
  WHERE (h.q + h.a) / (s.q + s.a) >= 0.6 AND h.q / s.q >= 0.3 AND h.a / s.a >= 0.3
)
SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT item_id)) AS items, max(overlap) AS overlap
FROM leaked GROUP BY doc_id
"""

# windows of 100 bytes as 200 hex digits; starts at most 100 bytes apart make one removed run
REPEATED_BYTES = """
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), windows AS (
  SELECT doc_id, p, substr(x, 2 * p + 1, 200) AS s
  FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS p FROM docs WHERE length(x) >= 200)
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1
), marked AS (
  SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM later
), numbered AS (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked
), runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs
), kept AS (
  SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head,
    max(b) AS tail, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""


def _nearest(books: str) -> str:
    d = "list_sum(list_transform(range(1, len(m.s) + 1), lambda i: (m.s[i] - c.s[i]) * (m.s[i] - c.s[i])))"
    return f"SELECT id, p, m.s, e, d FROM (SELECT m.vec_id AS id, m.p, m.s, c.e, {d} AS d, row_number() OVER (PARTITION BY m.vec_id, m.p ORDER BY {d}, c.e) AS k FROM members m JOIN {books} c ON m.p = c.p) m WHERE k = 1"


def _moved(nearest: str, books: str) -> str:
    return f"""SELECT c.p, c.e, coalesce(t.s, c.s) AS s FROM {books} c LEFT JOIN (
    SELECT p, e, list((total - ((total % n) + n) % n) // n ORDER BY i) AS s FROM (
      SELECT p, e, i, CAST(sum(s[i]) AS BIGINT) AS total, count(*) AS n FROM (SELECT p, e, s, unnest(range(1, len(s) + 1)) AS i FROM {nearest}) GROUP BY p, e, i
    ) GROUP BY p, e) t ON t.p = c.p AND t.e = c.e"""


PRODUCT_CODES = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), members AS (
  SELECT vec_id, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS s FROM kept, (SELECT unnest(range(16)) AS p)
), books0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, s FROM members
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)
), near0 AS MATERIALIZED ({_nearest("books0")}
), books1 AS MATERIALIZED ({_moved("near0", "books0")}
), near1 AS MATERIALIZED ({_nearest("books1")}
), books2 AS MATERIALIZED ({_moved("near1", "books1")}
), near2 AS MATERIALIZED ({_nearest("books2")}
), coded AS (
  SELECT id AS vec_id, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY id
), digest AS (
  SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM books2
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""

_CRC32 = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""

# a node is the list of its turns
PREFIX_TRIE = f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 100 AS base, {_CRC32} % 6 AS h FROM (SELECT DISTINCT c FROM turns)
), heads AS (
  SELECT v.c, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.base AND t.pos < v.h
), sizes AS (
  SELECT c, h, (SELECT count(*) FROM heads x WHERE x.c = v.c) AS m FROM convs v
), rebuilt AS (
  SELECT * FROM heads UNION ALL
  SELECT t.c, s.m + t.pos - s.h, t.role, t.text FROM turns t JOIN sizes s ON s.c = t.c WHERE t.pos >= s.h
), paths AS (
  SELECT v.c, coalesce((SELECT list({{'role': role, 'text': text}} ORDER BY pos) FROM rebuilt r WHERE r.c = v.c), []) AS path FROM convs v
), nodes AS (
  SELECT path[1:depth] AS node, depth, min(c) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (depth = len(path)), '') AS ends
  FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS depth FROM paths) GROUP BY path[1:depth], depth
), children AS (
  SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.node[1:n.depth] = n.node) AS n_children,
    CASE WHEN depth > 0 THEN (n_convs - 1) * length(node[depth].text) ELSE 0 END AS saved
  FROM nodes n
), subtrees AS (
  SELECT node[1:above] AS node, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT node, n_children, saved, unnest(range(0, depth + 1)) AS above FROM children) GROUP BY node[1:above]
)
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM children a JOIN subtrees s ON s.node = a.node LEFT JOIN nodes p ON a.depth > 0 AND p.depth = a.depth - 1 AND p.node = a.node[1:a.depth - 1]
"""
