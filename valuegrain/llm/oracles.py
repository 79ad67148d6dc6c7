"""DuckDB SQL of the queries that SQL can express. It states its constants itself."""

_SHARDS = """
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS h
  FROM documents
), bits AS (
  SELECT doc_id, size, list_aggregate(list_transform(range(1, 31), lambda i:
         lpad(bin(('0x' || substr(h, i::INT, 1))::INT), 4, '0')), 'string_agg', '') AS bits
  FROM hashed
), full_depths AS (
  SELECT d.depth, substr(bits, 1, d.depth) AS prefix, sum(size)::BIGINT AS bytes
  FROM bits, (SELECT unnest(range(0, 25))::INT AS depth) d
  GROUP BY ALL
), leaves AS (
  SELECT bits.doc_id, bits.size, f.prefix, f.depth, f.bytes,
         row_number() OVER (PARTITION BY bits.bits, bits.doc_id ORDER BY f.depth) AS r
  FROM bits JOIN full_depths f ON f.bytes <= 33554432 AND f.prefix = substr(bits.bits, 1, f.depth)
)
SELECT doc_id, size, 'b' || prefix AS shard, depth, bytes AS shard_bytes, true AS fits FROM leaves WHERE r = 1
"""

_MIX = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), coalesce(source, ''), coalesce(text, ''))) AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS s,
         [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w
  FROM sized GROUP BY source
), steps AS (
  -- Sources in the order in which a growing share reaches twice their size.
  SELECT *, coalesce(sum(2 * s) OVER (ORDER BY s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_words,
         sum(w) OVER (ORDER BY s / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
         1.5::DOUBLE * sum(s) OVER () AS budget
  FROM sources
), level AS (
  -- The first source whose share at that stage stays within its cap sets the level.
  SELECT full_words, open_weight, budget FROM steps
  WHERE (budget - full_words) * w / open_weight <= 2 * s
  ORDER BY full_words, open_weight DESC LIMIT 1
), targets AS (
  SELECT source, s, CASE WHEN (l.budget - l.full_words) * w / l.open_weight > 2 * s THEN (2 * s)::DOUBLE
                         ELSE (l.budget - l.full_words)::DOUBLE * w / l.open_weight END AS target
  FROM steps, level l
), placed AS (
  SELECT doc_id, size, source, key,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at
  FROM sized
)
SELECT p.doc_id, p.size, t.s AS source_size, t.target,
       (greatest(0, least(p.size, round(t.target)::BIGINT - p.at))
        + greatest(0, least(p.size, round(t.target)::BIGINT - t.s - p.at)))::BIGINT AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
"""

_TOP = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
  FROM scores
)
SELECT * FROM ranked WHERE rank <= 10
"""

_INFILL = """
WITH seeds AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s
  FROM documents
), numbers AS (
  SELECT *, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2,
         ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4
  FROM seeds
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

_LEXICAL = """
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), counts AS (
  SELECT r, any_value(doc_id) AS doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY r, term
), sizes AS (
  SELECT r, sum(tf)::BIGINT AS n FROM counts GROUP BY r
), totals AS (
  SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_terms FROM sizes
), weights AS (
  SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counts, totals GROUP BY term, all_docs
), wanted AS (
  SELECT i, item_id, term, count(*)::BIGINT AS repeats FROM (
    SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY i, item_id, term
), scores AS (
  SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
         sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_docs) // all_terms))))::BIGINT AS score
  FROM wanted JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (r), totals
  GROUP BY i, r
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""

ORACLES = {"op1_extendible_shards": _SHARDS, "op8_mixing": _MIX, "op9_top_products": _TOP}
ORACLES |= {"op11_infill": _INFILL, "op13_lexical_search": _LEXICAL}
