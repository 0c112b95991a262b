"""SQL for the queries of this package that SQL can express, for DuckDB."""

W = r"[^\x20\x09-\x0D]+"

OP8 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{W}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{W}')) AS ls
  FROM documents
), g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(t, '[^a-z]', '', 'g'))::BIGINT AS n_lower, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_shouts
  FROM d LEFT JOIN covered c USING (rid)
), f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
           + CASE WHEN 4 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
           + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END
           + CASE WHEN n_upper > 2 * n_lower AND n_upper >= 50 THEN 32 ELSE 0 END + CASE WHEN 2 * n_shouts > n_words THEN 64 ELSE 0 END)::BIGINT AS fail_bits
  FROM m
)
SELECT *, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 127) = 0 AS kept FROM f
"""

OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e, len(embedding) AS dim FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND c.dim = q.dim
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 10
"""

OP10 = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{W}'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 8))::BIGINT % 1024 AS bin
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source
), c AS (
  SELECT *, 3 * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap::DOUBLE ELSE
         (sum(source_size) OVER () - sum(CASE WHEN cap <= level * weight THEN cap ELSE 0 END) OVER ())::DOUBLE
         / sum(CASE WHEN cap <= level * weight THEN 0 ELSE weight END) OVER () * weight END AS target
  FROM c
), b AS (
  SELECT source, bin, sum(size)::BIGINT AS words FROM d GROUP BY ALL
), p AS (
  SELECT b.source, b.bin, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS times,
         b.words, coalesce(sum(b.words) OVER (PARTITION BY b.source ORDER BY b.bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source
)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (p.times * d.size + floor(CASE WHEN p.words = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (p.target - p.times * p.source_size - p.before) / p.words)) END * d.size))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.bin = p.bin
"""

ORACLES = {"op8_quality": OP8, "op9_topk": OP9, "op10_mixing": OP10}
