"""DuckDB SQL of the queries that SQL expresses, written from their definitions."""

from __future__ import annotations

_WORDS = r"words AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"

QUALITY = rf"""WITH {_WORDS},
tri AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM words, unnest(range(1, len(ws) - 1)) t(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY 1),
uses AS (SELECT doc_id, coalesce(source, '') AS host, trim(regexp_replace(translate(lower(l), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM words, unnest(string_split(text, chr(10))) t(l)),
hosts AS (SELECT coalesce(source, '') AS host, count(*) AS n FROM documents GROUP BY 1),
common AS (SELECT host, line FROM uses JOIN hosts USING (host) WHERE line <> '' GROUP BY host, line, hosts.n HAVING count(DISTINCT doc_id) > 20 AND count(DISTINCT doc_id) > 0.01 * hosts.n),
lost AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS n FROM uses JOIN common USING (host, line) GROUP BY 1),
base AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_removed_words FROM words LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id)),
flags AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_removed_words > 0.5 * n_words OR (n_removed_words > 0 AND n_words - n_removed_words < 30) AS depleted FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, depleted, NOT base_failed AND NOT depleted AS kept FROM flags"""

NEAR_DUPLICATES = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON m.a = d.doc_id"""


def substring_sql(levels: int = 11) -> str:
    """Levels 50, 100, ... of repeated windows; a level is built from pairs of the one before."""
    parts = [_WORDS, "c50 AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM words, unnest(range(1, len(ws) - 48)) t(i))", "r50 AS (SELECT * FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS lo, max(doc_id) OVER (PARTITION BY h) AS hi FROM c50) WHERE lo < hi)"]
    size = 50
    for _ in range(levels - 1):
        half, size = size, size * 2
        parts.append(f"c{size} AS (SELECT a.doc_id, a.i, md5(a.h || b.h) AS h FROM r{half} a JOIN r{half} b ON a.doc_id = b.doc_id AND b.i = a.i + {half})")
        parts.append(f"r{size} AS (SELECT doc_id, i, h FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS lo, max(doc_id) OVER (PARTITION BY h) AS hi FROM c{size}) WHERE lo < hi)")
    longest = " UNION ALL ".join(f"SELECT doc_id, {50 << k} AS k FROM r{50 << k}" for k in range(levels))
    parts += [
        "gone AS (SELECT DISTINCT doc_id, i + j AS i FROM r50, range(50) t(j) WHERE lo < doc_id)",
        "each_word AS (SELECT doc_id, i, ws[i] AS word FROM words, unnest(range(1, len(ws) + 1)) t(i))",
        "kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM each_word ANTI JOIN gone USING (doc_id, i) GROUP BY 1)",
        "lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)",
        f"longest AS (SELECT doc_id, max(k) AS k FROM ({longest}) GROUP BY 1)",
    ]
    return f"WITH {', '.join(parts)} SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256, coalesce(longest.k, 0)::BIGINT AS max_repeat FROM words w LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN longest USING (doc_id)"


ORACLE_SQL = {"op4_substring_dedup": substring_sql(), "op6_quality_rules": QUALITY, "op9_near_duplicates": NEAR_DUPLICATES}
