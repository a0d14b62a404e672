"""DuckDB SQL for the rows of the operators that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: CRC-32 of different words: the table of 256 remainders by its rule, then a fold over each word's bytes.
RESAMPLING = f"""
WITH remainders AS (
  SELECT list(c ORDER BY i) AS t
  FROM (
    SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(0, 256) r(i)
  )
),
source AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
),
words AS MATERIALIZED (SELECT row_id, doc_id, unnest(w) AS word FROM source),
wanted AS MATERIALIZED (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
  FROM benchmark
),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM words UNION SELECT word FROM wanted)),
bytes AS (
  SELECT word, list_transform(
    range(1, length(h), 2),
    lambda i: (instr('0123456789ABCDEF', substr(h, i, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, i + 1, 1)) - 1) AS b
  FROM hexed
),
buckets AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, remainders
),
s AS (SELECT bucket, count(*) AS n FROM words JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM wanted JOIN buckets USING (word) GROUP BY bucket),
sizes AS (SELECT (SELECT count(*) FROM words) AS all_s, (SELECT count(*) FROM wanted) AS all_t),
gains AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln(
    ((coalesce(t.n, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((coalesce(s.n, 0) + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket), sizes
),
weights AS (
  SELECT row_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM words JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY row_id
),
noise AS (
  SELECT row_id, doc_id, substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS h FROM source
),
scored AS MATERIALIZED (
  SELECT row_id, noise.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9),
      lambda i: (instr('0123456789abcdef', substr(h, i, 1)) - 1)::BIGINT)), lambda a, x: a * 16 + x) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM noise LEFT JOIN weights USING (row_id)
),
ranked AS (
  SELECT row_id, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN rank <= (SELECT count(*) FROM ranked) * 10 // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (row_id)
"""

COLLOCATIONS = f"""
WITH pieces AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]') AS parts
  FROM documents
),
piece AS (SELECT doc, lang, unnest(parts) AS part, generate_subscripts(parts, 1) AS p FROM pieces),
words AS MATERIALIZED (
  SELECT doc, lang, p, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT doc, lang, p, regexp_extract_all(part, '[^\\x20\\x09]+') AS w FROM piece)
),
places AS MATERIALIZED (
  SELECT lang, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4
  FROM words WINDOW o AS (PARTITION BY doc, p ORDER BY i)
),
runs AS (
  SELECT lang, 1 AS n, w1 AS phrase FROM places
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM places WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM places WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM places WHERE w4 IS NOT NULL
),
counted AS MATERIALIZED (SELECT lang, phrase, any_value(n)::INT AS n, count(*) AS f FROM runs GROUP BY lang, phrase HAVING count(*) >= 30),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
phrases AS MATERIALIZED (SELECT lang, phrase, n, f, string_split(phrase, ' ') AS w FROM counted WHERE n > 1 AND f >= 30),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM phrases, range(1, 4) c(k) WHERE k < n
),
rated AS (
  SELECT cuts.lang, cuts.phrase, a, h.f AS l, t.f AS r, k, ((2000000::HUGEINT * a) // (h.f::HUGEINT + t.f))::BIGINT AS score
  FROM cuts
  JOIN counted h ON h.lang = cuts.lang AND h.phrase = head
  JOIN counted t ON t.lang = cuts.lang AND t.phrase = tail
),
weakest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (
  SELECT lang, f, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM phrases, range(2, 4) q(m), range(1, 4) p(i) WHERE m < n AND i + m - 1 <= n
),
inside AS (SELECT lang, phrase, max(f) AS whole FROM parts GROUP BY lang, phrase),
best AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM weakest LEFT JOIN inside USING (lang, phrase)
  WHERE whole IS NULL OR whole::HUGEINT * 100 < a::HUGEINT * 80
)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN totals USING (lang) WHERE rank <= 2000
"""

METRIC_JOIN = """
WITH RECURSIVE rows AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, embedding::DOUBLE[] AS v FROM embeddings
),
good AS MATERIALIZED (
  SELECT row_id, vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM rows
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
),
links AS MATERIALIZED (
  SELECT a.row_id AS a, b.row_id AS b FROM good a, good b
  WHERE a.row_id <> b.row_id AND len(a.u) = len(b.u) AND CASE WHEN len(a.u) = len(b.u) THEN list_dot_product(a.u, b.u) END >= 0.9
),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
lowest AS (SELECT a AS row_id, min(vec_id) AS low FROM reach JOIN rows ON rows.row_id = reach.b GROUP BY a),
counted AS (SELECT a AS row_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(vec_id, low), vec_id, low) AS component_id,
  coalesce(vec_id = coalesce(least(vec_id, low), vec_id, low), false) AS kept
FROM rows LEFT JOIN lowest USING (row_id) LEFT JOIN counted USING (row_id)
"""
