"""DuckDB SQL for the queries of this folder that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

OP2 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g USING (h)
"""

OP3 = """
WITH raw AS (
  SELECT doc_id, t.i AS i, t.line AS line FROM (
    SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i, 'line': x})) AS t
    FROM documents WHERE text IS NOT NULL)),
keyed AS (SELECT doc_id, i, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS k FROM raw),
counted AS (SELECT doc_id, i, k, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM keyed WHERE k <> ''),
win AS (
  SELECT doc_id, pos, k AS a, lead(k) OVER w AS b, lead(k, 2) OVER w AS c
  FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS r FROM win WHERE c IS NOT NULL),
gone AS (
  SELECT DISTINCT c.doc_id, c.i FROM ranked x JOIN counted c ON c.doc_id = x.doc_id AND c.pos BETWEEN x.pos AND x.pos + 2
  WHERE x.r > 1),
kept AS (
  SELECT k.doc_id, string_agg(k.line, chr(10) ORDER BY k.i) AS text
  FROM keyed k LEFT JOIN gone g ON g.doc_id = k.doc_id AND g.i = k.i WHERE g.i IS NULL GROUP BY k.doc_id)
SELECT d.doc_id,
  CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
  (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id)::BIGINT AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

OP6 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
    [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s0),
s2 AS (SELECT *, cap / weight AS fills FROM s1),
s3 AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY fills, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY fills, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s2),
lvl AS (SELECT arg_min(lev, fills) AS lev FROM s3 WHERE lev <= fills),
goal AS (
  SELECT s3.source, source_size, least(cap, weight * coalesce((SELECT lev FROM lvl), 'inf'::DOUBLE)) AS target,
    ('0x' || substr(md5('0:' || coalesce('s' || source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off FROM s3),
r AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target, g.off,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS e,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id NULLS FIRST) - 1 AS k
  FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
c AS (
  SELECT *, CASE WHEN size > 0 THEN least(floor((k + 1) * e + off) - floor(k * e + off), 3) ELSE 0 END::BIGINT AS copies FROM r),
l AS (SELECT *, copies * size AS got, floor(target)::BIGINT - sum(copies * size) OVER (PARTITION BY source) AS lack FROM c),
m AS (SELECT *, CASE WHEN lack < 0 THEN got ELSE size * 3 - got END AS room FROM l),
n AS (
  SELECT *, coalesce(sum(room) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM m)
SELECT doc_id, source, size, source_size, target, copies,
  (got + CASE WHEN lack < 0 THEN -1 ELSE 1 END * greatest(0, least(room, abs(lack) - bef)))::BIGINT AS taken
FROM n
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2, "op3_line_dedup": OP3, "op6_mixing": OP6}
