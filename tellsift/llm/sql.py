"""The contract queries that SQL can say, for DuckDB."""

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

#: crc32 by its table of 256 values, over the bytes of the text.
OP1 = """
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT)) AS c
    FROM range(256) r(i))),
b AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: CAST('0x' || p AS BIGINT)) AS bytes
  FROM documents),
d AS (
  SELECT doc_id, CAST(size AS BIGINT) AS size,
         xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM b, tab),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM d),
s AS (SELECT *, CAST((start * 24) // total AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""

OP8 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM w),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * common >= 75 * (len(p.s) + len(q.s) - common)),
r AS (SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON m.id = doc_id
"""

OP9 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

OP10 = f"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5(concat_ws('|', CAST(doc_id AS VARCHAR), '2021')) AS o FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM g),
w AS (SELECT *, (n - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM k),
e AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS rest,
             sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest_weight
      FROM w WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * rest_weight <= rest * weight AS capped FROM e),
h AS (SELECT max(rest_weight) AS fw, arg_max(rest, rest_weight) AS fr FROM f WHERE NOT capped),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE)
             ELSE CAST(weight AS DOUBLE) * CAST(fr AS DOUBLE) / CAST(fw AS DOUBLE) END AS target FROM f LEFT JOIN h ON true),
p AS (SELECT d.*, source_size, target, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole,
             sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CAST(whole AS BIGINT) + CASE WHEN start + size / 2.0 < target - whole * source_size AND size > 0 THEN 1 ELSE 0 END AS copies FROM p)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, copies FROM q
"""

#: Pairs of equal words q apart, consecutive ones as stretches; of stretches at the same place the smallest period counts.
OP11 = f"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT)) AS c
    FROM range(256) r(i))),
h AS (
  SELECT row_number() OVER () AS id, doc_id, {WORDS} AS w,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda p: CAST('0x' || p AS BIGINT)),
             lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM documents, tab),
g AS (SELECT *, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % greatest(len(w), 1) AS a FROM h),
d AS (SELECT id, doc_id, n, CASE WHEN planted THEN
             list_transform(w, lambda x, i: CASE WHEN i - 1 < a THEN x ELSE w[a + (i - 1 - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END) ELSE w END AS w
      FROM g),
t AS (SELECT id, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
e AS (SELECT x.id, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.id = y.id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT id, q, min(i) AS start, count(*) + q AS length
      FROM (SELECT *, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island FROM e) GROUP BY id, q, island),
r AS (SELECT id, start, length, min(q) AS period FROM s WHERE length >= 6 AND length >= 4 * q GROUP BY id, start, length),
b AS (SELECT id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines,
             first({{'start': start, 'length': length, 'period': period}} ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS best
      FROM r GROUP BY id),
c AS (SELECT id, string_agg(word, ' ' ORDER BY i) AS kept FROM t
      WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id = t.id AND t.i >= r.start + r.period AND t.i < r.start + r.length) GROUP BY id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
       1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256, n AS n_words
FROM d LEFT JOIN b USING (id) LEFT JOIN c USING (id)
"""

OP12 = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, (2000000::HUGEINT * k.a) // (x.f + y.f) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k], ' ')
             JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, array_to_string(w[i:i + q - 1], ' ') AS phrase, max(a) AS f
      FROM (SELECT lang, a, m, w, q, unnest(range(1, m - q + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS q) WHERE q < m) GROUP BY 1, 2),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
      FROM b LEFT JOIN o USING (lang, phrase) WHERE o.f IS NULL OR 100::HUGEINT * o.f < 80::HUGEINT * b.a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score, CAST(k AS INTEGER) AS cut FROM z JOIN n USING (lang) WHERE rank <= 2000
"""
