"""SQL that states the results of the training-data queries, where SQL can."""

OP8 = r"""
WITH sizes AS (
  SELECT row_number() OVER () AS id, doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sizes GROUP BY source),
weighed AS (
  SELECT *, ([3.0, 1.0, 2.0])[((place - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         (source_size * 2)::DOUBLE AS ceiling FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, place
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY ceiling / weight, place
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
level AS (
  SELECT min_by(level, ceiling / weight * 1e6 + place) AS level
  FROM levels WHERE level * weight <= ceiling),
goals AS (
  SELECT source, source_size, place, least(ceiling, coalesce(level.level * weight, ceiling)) AS target
  FROM levels, level),
seat AS (
  SELECT source, place, target / (2 * k - 1) AS quotient
  FROM goals, LATERAL (SELECT unnest(range(1, ceil(target / 32)::BIGINT + 100)) AS k)
  WHERE target > 0),
won AS (
  SELECT place, count(*) AS seats FROM (
    SELECT place, row_number() OVER (ORDER BY quotient DESC, place) AS r FROM seat)
  WHERE r <= (SELECT round(sum(target) / 32) FROM goals) GROUP BY place),
plan AS (
  SELECT source, source_size, target, greatest(ceil(source_size / 32)::BIGINT, 1) AS nb,
         least(coalesce(seats, 0), ceil(source_size / 32)::BIGINT * 2) AS seats,
         ('0x' || substr(md5('blocks:7:' || coalesce('s' || source, 'n')), 1, 7))::BIGINT AS draw
  FROM goals LEFT JOIN won USING (place)),
placed AS (
  SELECT s.*, p.source_size, p.target, p.nb, p.seats, p.draw,
         sum(s.size) OVER (PARTITION BY s.source
           ORDER BY md5('7:' || coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size, s.id) - s.size AS p0
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
blocks AS (
  SELECT id, sum((seats // nb + CASE WHEN ((2147483647 % nb) * j + draw % nb) % nb < seats % nb THEN 1 ELSE 0 END)
               * (least(p0 + size, (j + 1) * 32) - greatest(p0, j * 32))) AS taken
  FROM placed, LATERAL (SELECT unnest(range((p0 // 32)::BIGINT, ((p0 + size - 1) // 32)::BIGINT + 1)) AS j)
  WHERE size > 0 GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM placed LEFT JOIN blocks USING (id)
"""

OP10 = r"""
WITH rows AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body,
         replace(replace(role, '\', '\\'), '<|', '<\|') AS head FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, body), '')) AS loss_sha256,
  sum(length(head) + length(body) + 23)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP13 = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
known AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS total FROM words WHERE len(terms) > 0),
posting AS (
  SELECT row, doc_id, len(terms)::BIGINT AS n, term, count(*)::BIGINT AS tf
  FROM (SELECT row, doc_id, terms, unnest(terms) AS term FROM words) GROUP BY ALL),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
weight AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM posting, known GROUP BY term),
scored AS (
  SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN posting USING (term), known GROUP BY item_id, row, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, row)::INT AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, row) <= 50
"""

SQL = {"op8_mixing": OP8, "op10_chat": OP10, "op13_search": OP13}
