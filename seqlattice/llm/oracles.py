"""DuckDB SQL that gives the rows of the queries whose operators SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13) a),
f AS (SELECT key, min(doc_id) AS first_doc FROM k GROUP BY key),
g AS (SELECT DISTINCT doc_id, i + o AS i FROM (SELECT k.doc_id, k.i FROM k JOIN f ON k.key = f.key WHERE f.first_doc < k.doc_id) b CROSS JOIN (SELECT unnest(range(0, 13)) AS o) c),
p AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM d WHERE len(w) > 0),
t AS (SELECT p.doc_id, count(*) AS n_words, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN p.word END, ' ' ORDER BY p.i), '') AS kept FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""

LINES = """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS key FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS n FROM w WHERE key IS NOT NULL),
g AS (SELECT DISTINCT doc_id, pos + o AS pos FROM r CROSS JOIN (SELECT unnest(range(0, 3)) AS o) c WHERE n > 1)
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS text
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
"""

#: Seats by ranking every quotient that can win one.
MIXING = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS hash FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
dh AS (SELECT *, substring(hash, 1, 2) AS part, substring(hash, 1, 4) AS shard FROM d),
wgt AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, 3.0::DOUBLE * source_size AS cap FROM src),
lev AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wgt),
tgt AS (SELECT source, source_size, least(cap, weight * (SELECT max(level) FROM lev WHERE cap >= level * weight)) AS target FROM lev),
sq AS (SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS r FROM (SELECT source, target, unnest(range(0, CAST(ceil(target / 4) AS BIGINT) + 2)) AS k FROM tgt) a),
ss AS (SELECT source, count(*) AS seats FROM sq WHERE r <= (SELECT round(sum(source_size) / 4.0) FROM src) GROUP BY source),
prt AS (SELECT h.source, h.part, h.part_size, t.source_size, coalesce(s.seats, 0) AS all_seats FROM (SELECT source, part, sum(size)::BIGINT AS part_size FROM dh GROUP BY 1, 2) h JOIN tgt t ON h.source IS NOT DISTINCT FROM t.source LEFT JOIN ss s ON h.source IS NOT DISTINCT FROM s.source),
pq AS (SELECT source, part, all_seats, row_number() OVER (PARTITION BY source ORDER BY part_size / (2 * k + 1)::DOUBLE DESC, part, k) AS r FROM (SELECT *, unnest(range(0, CAST(ceil(all_seats * part_size / greatest(source_size, 1)::DOUBLE) AS BIGINT) + 2)) AS k FROM prt) a),
ps AS (SELECT source, part, count(*) AS seats FROM pq WHERE r <= all_seats GROUP BY source, part),
shd AS (SELECT source, part, shard, sum(size)::BIGINT AS shard_size FROM dh GROUP BY 1, 2, 3),
cell AS (SELECT h.*, p.part_size, t.source_size, t.target, coalesce(s.seats, 0) AS all_seats FROM shd h JOIN tgt t ON h.source IS NOT DISTINCT FROM t.source JOIN prt p ON h.source IS NOT DISTINCT FROM p.source AND h.part = p.part LEFT JOIN ps s ON h.source IS NOT DISTINCT FROM s.source AND h.part = s.part),
cq AS (SELECT source, part, shard, all_seats, row_number() OVER (PARTITION BY source, part ORDER BY shard_size / (2 * k + 1)::DOUBLE DESC, shard, k) AS r FROM (SELECT *, unnest(range(0, CAST(ceil(all_seats * shard_size / greatest(part_size, 1)::DOUBLE) AS BIGINT) + 2)) AS k FROM cell) a),
cs AS (SELECT source, shard, count(*) AS seats FROM cq WHERE r <= all_seats GROUP BY source, shard),
quo AS (SELECT c.*, CASE WHEN target >= 3 * c.source_size THEN 3 * c.shard_size ELSE least(coalesce(s.seats, 0) * 4, 3 * c.shard_size) END AS quota FROM cell c LEFT JOIN cs s ON c.source IS NOT DISTINCT FROM s.source AND c.shard = s.shard),
pl AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY hash, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM dh)
SELECT p.doc_id, p.size, q.source_size, q.target, CAST(CASE WHEN q.shard_size > 0 THEN (q.quota // q.shard_size) * p.size + greatest(0, least(q.quota % q.shard_size - p.lo, p.size)) ELSE 0 END AS BIGINT) AS taken
FROM pl p JOIN quo q ON p.source IS NOT DISTINCT FROM q.source AND p.shard = q.shard
"""

#: Every lag of every word; a run within another of smaller period has that period.
RUNS = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, {_WORDS} AS w,
    xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: list_reduce([xor(h, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM documents),
e AS (SELECT doc_id, k, w, len(w) AS n, coalesce(h % 10 = 0, false) AND len(w) > 0 AS chosen, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN chosen THEN g % n END AS a, CASE WHEN chosen THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM e),
i AS (SELECT doc_id, k, n, w, chosen, a, p, unnest(range(0, n)) AS i FROM f),
t AS (SELECT k, n, i, w[1 + CASE WHEN chosen AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM i),
m AS (SELECT y.k, y.i - x.i AS q, y.i, y.i - row_number() OVER (PARTITION BY y.k, y.i - x.i ORDER BY y.i) AS island
    FROM t x JOIN t y ON x.k = y.k AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= y.n),
c AS (SELECT k, q, min(i) - q AS s, count(*) + q AS len FROM m GROUP BY k, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.k = c.k AND o.q < c.q AND o.s <= c.s AND o.s + o.len >= c.s + c.len)),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CAST(len AS DOUBLE) / q DESC, s, q) AS best FROM r),
u AS (SELECT k, count(*) AS n_runs, max(CASE WHEN best = 1 THEN s END) AS start, max(CASE WHEN best = 1 THEN len END) AS length, max(CASE WHEN best = 1 THEN q END) AS period, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM b GROUP BY k),
g AS (SELECT DISTINCT k, unnest(range(s + q, s + len)) AS i FROM r),
v AS (SELECT t.k, string_agg(t.word, ' ' ORDER BY t.i) AS kept FROM t LEFT JOIN g ON t.k = g.k AND t.i = g.i WHERE g.i IS NULL GROUP BY t.k)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN u ON d.k = u.k LEFT JOIN v ON d.k = v.k
"""

SEARCH = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM d WHERE len(w) > 0),
t AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d) u WHERE term IN (SELECT term FROM q) GROUP BY k, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM t CROSS JOIN c GROUP BY term, n_docs),
s AS (SELECT q.item_id, d.doc_id, d.k, CAST(sum(f.weight * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 90 + (90 * len(d.w) * n_docs) // n_words)))) AS BIGINT) AS score
    FROM t JOIN q ON t.term = q.term JOIN f ON t.term = f.term JOIN d ON t.k = d.k CROSS JOIN c GROUP BY q.item_id, d.doc_id, d.k),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op4_exact_top_k": TOP_K, "op5_substring_dedup": SUBSTRINGS, "op7_mix_sources": MIXING, "op10_line_dedup": LINES, "op11_periodic_runs": RUNS, "op13_ranked_search": SEARCH}
