"""DuckDB SQL for the operators whose whole result SQL can express."""

#: Every window of every text, grouped by its digest; runs of covered bytes as islands.
OP3 = r"""
WITH rows AS (SELECT row_number() OVER () AS u, doc_id, encode(coalesce(text, '')) AS body FROM documents),
starts AS (SELECT u, unnest(range(1, octet_length(body) - 198)) AS i, body FROM rows WHERE octet_length(body) >= 200),
windows AS (SELECT u, i, md5(body[i:i + 199]) AS w FROM starts),
again AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hits AS (SELECT u, i FROM windows SEMI JOIN again USING (w)),
marked AS (SELECT u, i, CASE WHEN i > lag(i) OVER (PARTITION BY u ORDER BY i) + 200 THEN 1 WHEN lag(i) OVER (PARTITION BY u ORDER BY i) IS NULL THEN 1 ELSE 0 END AS fresh FROM hits),
islands AS (SELECT u, i, sum(fresh) OVER (PARTITION BY u ORDER BY i) AS k FROM marked),
spans AS (SELECT u, k, min(i) AS a, max(i) + 199 AS b FROM islands GROUP BY u, k),
pieces AS (SELECT u, a, b, coalesce(lag(b) OVER (PARTITION BY u ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT u, sum(b - a + 1) AS n_removed, count(*) AS n_spans, string_agg(hex(body[before + 1:a - 1]), '' ORDER BY a) AS front, max(b) AS last FROM pieces JOIN rows USING (u) GROUP BY u)
SELECT doc_id, CAST(octet_length(body) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
sha256(CASE WHEN n_spans IS NULL THEN body ELSE unhex(front || hex(body[last + 1:octet_length(body)])) END) AS kept_sha256
FROM rows LEFT JOIN cut USING (u)
"""

#: Counts by lists; sketches, quartiles and drawn fences as the operator defines them.
OP7 = r"""
WITH t AS (SELECT row_number() OVER () AS u, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT u, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
windows AS (SELECT u, i, hash(w[i:i + 4]) AS k FROM (SELECT u, w, unnest(range(1, len(w) - 3)) AS i FROM split WHERE len(w) >= 5)),
twice AS (SELECT u, i FROM windows QUALIFY count(*) OVER (PARTITION BY u, k) > 1),
covered AS (SELECT u, count(DISTINCT j) AS n FROM (SELECT u, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY u),
counted AS (SELECT u, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM t JOIN split USING (u) LEFT JOIN covered USING (u)),
rated AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share FROM counted),
signals AS (SELECT lang, source, s.k AS k, s.x AS x FROM (SELECT lang, source, unnest([{'k': 1, 'x': mean_word}, {'k': 2, 'x': symbol_share}, {'k': 3, 'x': dup_line_share}, {'k': 4, 'x': repeat_share}]) AS s FROM rated WHERE n_words > 0)),
bucketed AS (SELECT lang, source, k, CASE WHEN x > 1e-6 THEN ceil(ln(x) / ln(CAST(1.02 AS DOUBLE))) END AS bucket FROM signals),
levels AS (SELECT 1 AS level, lang, source, k, bucket FROM bucketed UNION ALL SELECT 2, lang, NULL, k, bucket FROM bucketed UNION ALL SELECT 3, NULL, NULL, k, bucket FROM bucketed),
sketches AS (SELECT level, lang, source, k, bucket, count(*) AS n FROM levels GROUP BY ALL),
ranked AS (SELECT level, lang, source, k, coalesce(power(CAST(1.02 AS DOUBLE), bucket) * (2 / CAST(2.02 AS DOUBLE)), 0) AS value, sum(n) OVER g AS total, sum(n) OVER (PARTITION BY level, lang, source, k ORDER BY bucket NULLS FIRST) AS upto FROM sketches WINDOW g AS (PARTITION BY level, lang, source, k)),
quartiles AS (SELECT level, lang, source, k, max(total) AS total, min(value) FILTER (upto >= ceil(total * CAST(0.25 AS DOUBLE))) AS q1, min(value) FILTER (upto >= ceil(total * CAST(0.75 AS DOUBLE))) AS q3 FROM ranked GROUP BY ALL),
fences AS (SELECT level, lang, source, k, total, q1 - 3 * greatest(q3 - q1, [0.5, 0.05, 0.2, 0.05][k]) AS low, q3 + 3 * greatest(q3 - q1, [0.5, 0.05, 0.2, 0.05][k]) AS high FROM quartiles),
drawn AS (SELECT a.lang, a.source, a.k, (a.total * a.low + 200 * ((b.total * b.low + 200 * c.low) / (b.total + 200))) / (a.total + 200) AS low, (a.total * a.high + 200 * ((b.total * b.high + 200 * c.high) / (b.total + 200))) / (a.total + 200) AS high FROM fences a JOIN fences b ON b.level = 2 AND b.lang IS NOT DISTINCT FROM a.lang AND b.k = a.k JOIN fences c ON c.level = 3 AND c.k = a.k WHERE a.level = 1),
bounds AS (SELECT lang, source, max(low) FILTER (k = 1) AS l1, max(high) FILTER (k = 1) AS h1, max(high) FILTER (k = 2) AS h2, max(high) FILTER (k = 3) AS h3, max(high) FILTER (k = 4) AS h4 FROM drawn GROUP BY lang, source)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(mean_word BETWEEN l1 AND h1 AND symbol_share <= h2 AND dup_line_share <= h3 AND repeat_share <= h4, false) AS kept
FROM rated LEFT JOIN bounds ON bounds.lang IS NOT DISTINCT FROM rated.lang AND bounds.source IS NOT DISTINCT FROM rated.source
"""

#: All pairs that share a run of words, by a join; groups by reachability.
OP9 = r"""
WITH RECURSIVE rows AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
classes AS (SELECT text, min(doc_id) AS class_id, count(*) AS n_copies, row_number() OVER (ORDER BY min(doc_id), text) AS v FROM rows GROUP BY text),
words AS (SELECT v, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM classes),
runs AS (SELECT DISTINCT v, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS run FROM (SELECT v, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
named AS (SELECT v, hash(run) AS run FROM runs),
sizes AS (SELECT v, count(*) AS n FROM named GROUP BY v),
shared AS (SELECT a.v AS a, b.v AS b, count(*) AS n FROM named a JOIN named b ON a.run = b.run AND a.v < b.v GROUP BY a.v, b.v),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.v = a JOIN sizes y ON y.v = b WHERE shared.n >= 0.8 * (x.n + y.n - shared.n) - 1e-9),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS v, a AS r FROM both_ways UNION SELECT both_ways.b, reach.r FROM reach JOIN both_ways ON both_ways.a = reach.v),
roots AS (SELECT v, min(r) AS r FROM reach GROUP BY v),
groups AS (SELECT r, min(class_id) AS group_id FROM roots JOIN classes USING (v) GROUP BY r),
degrees AS (SELECT a AS v, count(*) AS n_links FROM both_ways GROUP BY a)
SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(group_id, class_id) AS group_id, n_copies
FROM rows JOIN classes USING (text) LEFT JOIN degrees USING (v) LEFT JOIN roots USING (v) LEFT JOIN groups USING (r)
"""
