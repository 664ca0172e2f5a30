"""SQL of the corpus operators that SQL can express (DuckDB), each over its whole table."""

#: All pairs that share a shingle, and what they reach.
NEAR_DEDUP = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM shingles),
rows AS (SELECT doc_id, unnest(s) AS g FROM shingles),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM rows a JOIN rows b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)
), both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM sizes
  UNION SELECT reach.u, both_ways.v FROM reach JOIN both_ways ON reach.v = both_ways.u
)
SELECT s.doc_id, s.n AS n_shingles, min(r.v) AS component_id, min(r.v) = s.doc_id AS kept FROM sizes s JOIN reach r ON r.u = s.doc_id GROUP BY s.doc_id, s.n
"""

#: Every string of 100 bytes, written as hexadecimal digits; cut from parts so that no text is scanned per string.
REPEATS = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT doc_id, a, substring(h, 2 * a + 1, 710) AS part FROM docs, LATERAL (SELECT unnest(range(0, greatest(len(h) // 2 - 99, 0), 256)) AS a)),
windows AS (SELECT doc_id, a + i AS p, substring(part, 2 * i + 1, 200) AS w FROM parts, LATERAL (SELECT unnest(range(0, least(len(part) // 2 - 99, 256))) AS i)),
named AS (SELECT doc_id, p, md5_number(w) AS w FROM windows),
later AS (SELECT doc_id, p FROM named QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1),
gaps AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 1 ELSE 0 END AS g FROM later),
grouped AS (SELECT doc_id, p, sum(g) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM gaps),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM grouped GROUP BY ALL),
between_spans AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e, k FROM spans
  UNION ALL SELECT doc_id, max(b), NULL, NULL FROM spans GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, string_agg(substring(d.h, 2 * s + 1, 2 * (coalesce(e, len(d.h) // 2) - s)), '' ORDER BY s) AS h FROM between_spans JOIN docs d USING (doc_id) GROUP BY d.doc_id
), counted AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM docs d LEFT JOIN counted c ON c.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

#: Windows turn by turn; what is read back is what the turns say.
CHAT = r"""
WITH said AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|/?s>|/?INST\])', '\1\\\2\3', 'g') AS body,
    replace(replace(regexp_replace(role, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|/?s>|/?INST\])', '\1\\\2\3', 'g'), '%', '%25'), chr(10), '%0A') AS head
  FROM said
), turns AS (
  SELECT *, row_number() OVER o - 1 AS nth, CAST(ceil(length(text) / 4.0) + 4 AS BIGINT) AS tokens,
    CAST(sum(ceil(length(text) / 4.0) + 4) OVER o AS BIGINT) AS total, length(head) + length(body) + 24 AS chars
  FROM escaped WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
), convs AS (
  SELECT conv_id, count(*) AS n, max(role = 'system' AND nth = 0) AS has_system, max(CASE WHEN nth = 0 THEN tokens END) AS lead_tokens,
    max(CASE WHEN nth = 0 THEN chars END) AS lead_chars,
    list(total ORDER BY nth) AS totals, list(tokens ORDER BY nth) AS sizes, list(chars ORDER BY nth) AS chars
  FROM turns GROUP BY conv_id
), rooms AS (SELECT *, greatest(1, 768 - CASE WHEN has_system THEN lead_tokens ELSE 0 END) AS room FROM convs),
starts AS (
  WITH RECURSIVE s AS (
    SELECT conv_id, 0 AS first, 0 AS k FROM rooms
    UNION ALL
    SELECT * FROM (
      SELECT r.conv_id, list_min(list_filter(range(s.first + 1, r.n), lambda i: r.totals[i + 1] - (r.totals[s.first + 1] - r.sizes[s.first + 1]) > r.room)) AS first, s.k + 1 AS k
      FROM s JOIN rooms r USING (conv_id)
    ) WHERE first IS NOT NULL
  ) SELECT * FROM s
), bounds AS (
  SELECT conv_id, k, first, coalesce(lead(first) OVER (PARTITION BY conv_id ORDER BY k), n) AS after, r.* EXCLUDE (conv_id),
    CASE WHEN has_system AND first > 0 THEN 1 ELSE 0 END AS led FROM starts JOIN rooms r USING (conv_id)
), windows AS (
  SELECT *, len(list_filter(range(greatest(led, first - 2), first), lambda i: (totals[first + 1] - sizes[first + 1]) - (totals[i + 1] - sizes[i + 1]) <= 256)) AS fits FROM bounds
), sums AS (
  SELECT conv_id, count(*) AS n_windows, CAST(sum(led * lead_chars + coalesce(list_sum(chars[first - fits + 1 : after]), 0)) AS BIGINT) AS formatted_chars FROM windows GROUP BY conv_id
), texts AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth) AS whole,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY nth), '') AS loss FROM turns GROUP BY conv_id
)
SELECT t.conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, n_windows
FROM texts t JOIN sums s ON s.conv_id IS NOT DISTINCT FROM t.conv_id
"""

#: The checksum of each distinct feature, byte by byte with a table of 256 registers; then counts, gains, weights and ranks.
IMPORTANCE = r"""WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t),
raw AS (SELECT 0 AS target, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT target, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM raw),
f AS (SELECT target, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM w),
n AS (SELECT target, id, f, count(*) AS n FROM f GROUP BY ALL),
d AS (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM n)),
c AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: CAST((instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1 AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM d, tab),
b AS (SELECT target, id, bucket, sum(n) AS n FROM n JOIN c USING (f) GROUP BY ALL),
k AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE target = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE target = 1), 0) AS t FROM b GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM k) + 10000) AS DOUBLE) / CAST((s + 1) * ((SELECT sum(t) FROM k) + 10000) AS DOUBLE))) AS gain FROM k),
x AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM b JOIN g USING (bucket) WHERE target = 0 GROUP BY id),
y AS (SELECT id AS doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN x USING (id) WHERE target = 0),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_words >= 20)
SELECT y.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 5 // 100 FROM r) THEN rank END AS rank FROM y LEFT JOIN r USING (doc_id)"""
