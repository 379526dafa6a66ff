"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from .mixing import BLOCK, GOLDEN, PERIOD

#: The mix by plain windows over whole tables: the same sizes, targets, shuffled order and schedule.
SOURCE_MIX = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS pos FROM sized GROUP BY source),
s1 AS (SELECT *, CASE pos % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS lim FROM s0),
s2 AS (SELECT *, lim::DOUBLE / weight AS ratio, (sum(source_size) OVER ())::BIGINT AS total FROM s1),
s3 AS (
  SELECT *, (total * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY ratio, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / (sum(weight) OVER (ORDER BY ratio, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS lvl FROM s2),
s4 AS (SELECT *, max(CASE WHEN ratio > lvl THEN lvl END) OVER () AS level FROM s3),
s5 AS (SELECT pos, source, source_size, CASE WHEN ratio <= lvl THEN lim::DOUBLE ELSE level * weight END AS target FROM s4),
s6 AS (
  SELECT *, floor(target)::BIGINT AS words, ceil(source_size / {BLOCK})::BIGINT AS blocks,
    CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS rounds FROM s5),
s7 AS (SELECT *, rounds * blocks + ceil((words - rounds * source_size) / {BLOCK})::BIGINT AS slots FROM s6),
s8 AS (SELECT *, (sum(slots) OVER (ORDER BY pos))::BIGINT AS upto, (sum(slots) OVER ())::BIGINT AS slots_all FROM s7),
src AS (
  SELECT *, CASE WHEN slots_all > 0 THEN floor((upto - slots) / slots_all * {PERIOD}) ELSE 0 END::BIGINT AS lo,
    CASE WHEN slots_all > 0 THEN floor(upto / slots_all * {PERIOD}) ELSE 0 END::BIGINT AS hi FROM s8),
placed AS (
  SELECT d.doc_id, d.source, d.size, s.source_size, s.target, s.pos,
    coalesce(sum(d.size) OVER (PARTITION BY s.pos ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id NULLS FIRST, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized d JOIN src s ON d.source IS NOT DISTINCT FROM s.source),
points AS (SELECT i AS id, ((i % {PERIOD}) * {GOLDEN}) % {PERIOD} AS point FROM (SELECT unnest(range((SELECT coalesce(max(slots_all), 0) FROM src))) AS i)),
drawn AS (
  SELECT s.pos, p.id AS slot, row_number() OVER (PARTITION BY s.pos ORDER BY p.id) AS rank FROM points p JOIN src s ON p.point >= s.lo AND p.point < s.hi),
got AS (SELECT pos, count(*) AS got FROM drawn GROUP BY pos),
ranks AS (
  SELECT pos, rank, slot FROM drawn UNION ALL
  SELECT pos, unnest(range(coalesce(got, 0) + 1, slots + 1)), slots_all + pos FROM src LEFT JOIN got USING (pos) WHERE slots > coalesce(got, 0)),
slots AS (
  SELECT r.pos, r.slot, (r.rank - 1) % s.blocks AS block,
    least((r.rank - 1) // s.blocks * s.source_size + (r.rank - 1) % s.blocks * {BLOCK} + {BLOCK}, ((r.rank - 1) // s.blocks + 1) * s.source_size, s.words)
      - ((r.rank - 1) // s.blocks * s.source_size + (r.rank - 1) % s.blocks * {BLOCK}) AS w
  FROM ranks r JOIN src s USING (pos) WHERE r.rank <= s.slots),
parts AS (SELECT pos, start, size, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS block FROM placed WHERE size > 0),
taken AS (
  SELECT p.pos, p.start, sum(greatest(0, least(p.start + p.size, block * {BLOCK} + w) - greatest(p.start, block * {BLOCK})))::BIGINT AS taken,
    min(CASE WHEN least(p.start + p.size, block * {BLOCK} + w) > greatest(p.start, block * {BLOCK}) THEN slot END)::BIGINT AS first_slot
  FROM parts p JOIN slots USING (pos, block) GROUP BY p.pos, p.start)
SELECT p.doc_id, p.source, p.size, p.source_size, p.target, coalesce(t.taken, 0) AS taken, coalesce(t.first_slot, -1) AS first_slot
FROM placed p LEFT JOIN taken t ON p.pos = t.pos AND p.start = t.start AND p.size > 0
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_source_mix": SOURCE_MIX}
