"""DuckDB SQL for the queries of this subpackage that SQL can express, over the same tables."""

def reached(share: str) -> str:
    """The time at which a source's schedule has used this share of its words, by the source's weight."""
    return f"""CASE WHEN weight = 5 THEN 1.5 - sqrt(2.25 - 2 * {share}) WHEN weight = 2 THEN {share}
    WHEN {share} < 0.3125 THEN 0.5 * (sqrt(0.0625 + 1.5 * {share} / 0.5) - 0.25) / 0.75 ELSE 0.5 + 0.5 * (sqrt(1 + 1.5 * ({share} - 0.3125) / 0.5) - 1) / 0.75 END"""


#: Filling is written as its fixed point: a source is full if its size per weight is below the level of the others.
MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3]::DOUBLE AS weight FROM sized GROUP BY source),
levels AS (
  SELECT a.source, (SELECT sum(source_size) FROM named) AS total,
    (SELECT coalesce(sum(3.0 * b.source_size), 0) FROM named b WHERE 3.0 * b.source_size / b.weight < 3.0 * a.source_size / a.weight) AS below,
    (SELECT sum(b.weight) FROM named b WHERE 3.0 * b.source_size / b.weight >= 3.0 * a.source_size / a.weight) AS weights,
    3.0 * a.source_size / a.weight AS ceiling FROM named a),
level AS (SELECT min_by((total - below) / weights, ceiling) AS v FROM levels WHERE ceiling >= (total - below) / weights),
goal AS (SELECT source, source_size, least(3.0 * source_size, weight * v) AS target, weight FROM named CROSS JOIN level),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, weight, floor(g.target)::BIGINT AS words, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END::BIGINT AS whole,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY ('0x' || substr(md5('11:' || coalesce(s.doc_id::VARCHAR, '')), 1, 15))::BIGINT, s.doc_id NULLS FIRST, s.size ROWS UNBOUNDED PRECEDING) - s.size AS a
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
cut AS (SELECT *, least(size, greatest(0, words - whole * source_size - a)) AS rest FROM placed),
filled AS (
  SELECT doc_id, size, source_size, target, weight, a / target AS share, (whole * size + rest)::BIGINT AS taken, (whole + (rest > 0 AND 2 * rest >= size)::INT)::INT AS copies, a FROM cut),
ends AS (SELECT *, (a + (copies - 1) * source_size) / target AS last FROM filled)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken, copies, CASE WHEN taken > 0 THEN round({reached("share")}, 6) END AS position,
  CASE WHEN copies > 0 THEN round({reached("last")}, 6) END AS last_position FROM ends
"""

QUALITY_RULES = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
tri AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS o FROM rep) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, t, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) AS n_lines
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars > 14 * n_words OR word_chars < 2 * n_words
    OR (n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines) OR 10 * length(regexp_replace(t, '[^\\p{L}]', '', 'g')) < 6 * word_chars
    OR 2 * length(regexp_replace(t, '[^\\p{Lu}]', '', 'g')) > word_chars) AS kept
FROM b
"""

#: Base32 of the SHA-1's 160 bits, five at a time.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT p.page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ('0b' || substr(unhex(p.h)::BIT::VARCHAR, 5 * i + 1, 5))::INT, 1)), '') AS payload_digest,
  CASE WHEN p.page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN p.page_id > first THEN first END AS refers_to
FROM p JOIN g ON p.h = g.h
"""

SUBSTRING_DEDUP = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
m AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
n AS (SELECT g.k, first, min(i) AS start FROM g JOIN m ON g.k = m.k AND g.doc_id = first GROUP BY g.k, first),
c AS (SELECT DISTINCT doc_id, i + o AS p FROM (SELECT g.doc_id, i, unnest(range(20)) AS o FROM g JOIN n ON g.k = n.k WHERE g.doc_id <> first OR i <> start)),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
k AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.p) AS t FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.p = c.p WHERE c.p IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

NEAR_DUPLICATES = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS v, doc_id AS u FROM d UNION SELECT r.v, l.b FROM r JOIN l ON r.u = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT v, min(u) AS c FROM r GROUP BY v) t ON d.doc_id = v
"""
