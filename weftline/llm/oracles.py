"""DuckDB SQL of operators whose rows SQL can express on small tables."""

SUBSTRING_DEDUP = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
m AS (SELECT g, min(doc_id) AS least FROM g GROUP BY 1),
c AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM g JOIN m USING (g) WHERE least < doc_id)),
s AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (first) AS n_spans FROM (SELECT doc_id, coalesce(j - lag(j) OVER (PARTITION BY doc_id ORDER BY j) > 1, true) AS first FROM c) GROUP BY 1),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM w) ANTI JOIN c USING (doc_id, j) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)"""

#: Lower-casing by translate(), as only A-Z are folded.
JACCARD_JOIN = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY 1), d AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(least, w.doc_id)) AS component_id, coalesce(n_links, 0) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id LEFT JOIN d ON d.a = w.doc_id"""

#: Bytes that a 200-byte string covers which also starts elsewhere; UTF-8 bytes as hex, two digits each.
SUFFIX_DEDUP = r"""WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, i, md5(substr(x, 2 * i - 1, 400)) AS g FROM (SELECT doc_id, x, unnest(range(1, len(x) // 2 - 198)) AS i FROM b)),
m AS (SELECT g FROM g GROUP BY 1 HAVING count(*) > 1),
h AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true) AS first FROM g SEMI JOIN m USING (g)),
n AS (SELECT doc_id, i, sum(first::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM h),
s AS (SELECT doc_id, span, min(i) AS a, max(i) + 199 AS z FROM n GROUP BY 1, 2),
o AS (SELECT doc_id, span, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) AS kept FROM o JOIN b USING (doc_id) GROUP BY 1)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN last IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256 FROM b LEFT JOIN k USING (doc_id)"""

#: Base columns of the quality rules.
QUALITY_BASE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM g JOIN (SELECT doc_id, g FROM g GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, g)) GROUP BY 1),
o AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
(len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM o"""
