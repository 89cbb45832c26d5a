"""DuckDB SQL for the queries that SQL can express."""

EXACT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
             row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS place FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM r
"""

# The water level: sources in order of size to weight, full while their share exceeds their most.
MIXING = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM s0),
s2 AS (SELECT *, CASE source_no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most FROM s1),
s3 AS (SELECT *, (SELECT sum(source_size) FROM s2) - coalesce(sum(most) OVER o, 0) AS rest,
              (SELECT sum(weight) FROM s2) - coalesce(sum(weight) OVER o, 0) AS share,
              row_number() OVER (ORDER BY CAST(most AS DOUBLE) / weight, source_no) AS place
       FROM s2 WINDOW o AS (ORDER BY CAST(most AS DOUBLE) / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, rest * weight > most * share AS filled FROM s3),
lev AS (SELECT min(place) AS place FROM s4 WHERE NOT filled),
line AS (SELECT rest AS level_rest, share AS level_share FROM s4 JOIN lev USING (place)),
s5 AS (SELECT source, source_size,
              CASE WHEN filled THEN CAST(most AS DOUBLE) ELSE CAST(CAST(level_rest * weight AS BIGINT) AS DOUBLE) / CAST(CAST(level_share AS BIGINT) AS DOUBLE) END AS target,
              CAST(CAST('0x' || substr(md5('0:' || coalesce('=' || source, 'null')), 1, 4) AS BIGINT) AS DOUBLE) / 65536.0 AS u
       FROM s4, line),
r AS (SELECT d.doc_id, d.size, s5.source_size, s5.target, s5.u, s5.target / CAST(nullif(s5.source_size, 0) AS DOUBLE) AS ratio,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS n
      FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, source_size, target,
       CAST(size * coalesce(least(CAST(floor(u + ratio * n) - floor(u + ratio * (n - 1)) AS BIGINT), 3), 0) AS BIGINT) AS taken
FROM r
"""

ORACLES = {"op4_exact_dedup": EXACT, "op7_mixing": MIXING}
