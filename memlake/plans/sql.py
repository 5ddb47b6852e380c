"""Fragments of the SQL that queries equal: the same cleaned tables, as common table expressions."""

from __future__ import annotations

T0 = 1704067200.0
START, END = T0 + 10 * 86400, T0 + 20 * 86400

O = "o AS (SELECT * FROM observations QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY received_at) = 1)"
E = (
    "e AS (SELECT * FROM entities WHERE entity_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id"
    " ORDER BY created_at DESC NULLS LAST, status DESC NULLS LAST, label DESC NULLS LAST) = 1)"
)
#: (entity_id, label, type) of a table of ids {0}.
LABELLED = """(SELECT * FROM (SELECT i.*, coalesce(e.type, CASE WHEN i.entity_id LIKE 'scene:%' THEN 'scene' END) AS type,
  CASE WHEN e.type IS NOT NULL THEN coalesce(nullif(e.label, ''), upper(e.type[1]) || lower(e.type[2:]) || ' ' || right(i.entity_id, 6))
       WHEN i.entity_id LIKE 'scene:%' THEN coalesce(l.name, i.entity_id[7:]) END AS label
  FROM {0} i LEFT JOIN e ON e.entity_id = i.entity_id
  LEFT JOIN locations l ON i.entity_id LIKE 'scene:%' AND l.location_id = i.entity_id[7:]) WHERE label IS NOT NULL)"""
SUBJECTS = f"""s0 AS (SELECT entity_id FROM e UNION SELECT DISTINCT subject_entity_id FROM observations WHERE subject_entity_id LIKE 'scene:%'),
s AS (SELECT * FROM {LABELLED.format('s0')})"""
SNAPSHOTS = """sn0 AS (SELECT DISTINCT location_id, CAST(floor(ts / 1800) * 1800 AS DOUBLE) AS ts, subject_entity_id FROM observations
  WHERE location_id IS NOT NULL AND ts IS NOT NULL AND subject_entity_id LIKE 'ent\\_%' ESCAPE '\\'),
sn AS (SELECT location_id, ts, list_sort(list(subject_entity_id)) AS present_entity_ids,
  'snap_' || sha256(location_id || chr(31) || CAST(CAST(ts AS BIGINT) AS VARCHAR))[1:12] AS snapshot_id FROM sn0 GROUP BY 1, 2)"""
HABITS = f"""h0 AS (SELECT *, strftime(make_timestamp(CAST(ts * 1000000 AS BIGINT)), '%Y-%m-%d') AS day,
  strftime(make_timestamp(CAST(ts * 1000000 AS BIGINT)), '%H') || 'h' AS hh,
  lower(strftime(make_timestamp(CAST(ts * 1000000 AS BIGINT)), '%a')) AS wd
  FROM o WHERE predicate = 'present' AND location_id IS NOT NULL AND subject_entity_id IS NOT NULL AND ts IS NOT NULL),
h1 AS (SELECT *, unnest(['present_around_' || hh, 'present_' || wd || '_around_' || hh]) AS p FROM h0),
habits AS (SELECT subject_entity_id, location_id, p AS predicate, count(DISTINCT day) AS days, list_sort(list(DISTINCT observation_id)) AS evidence
  FROM h1 GROUP BY 1, 2, 3 HAVING count(DISTINCT day) >= 2)"""
RELATIONS = """near_ AS (SELECT subject_entity_id, object_entity_id, count(*) AS times, list_sort(list(DISTINCT observation_id)) AS evidence
  FROM o WHERE predicate = 'near' AND object_entity_id IS NOT NULL AND subject_entity_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3),
often_ AS (SELECT subject_entity_id, location_id, count(*) AS times, list_sort(list(DISTINCT observation_id)) AS evidence
  FROM o WHERE predicate = 'present' AND location_id IS NOT NULL AND subject_entity_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3),
rel AS (SELECT n.subject_entity_id, CASE WHEN lower(e.label) IN ('bird','cat','dog','horse','sheep','cow','elephant','bear','zebra','giraffe')
         THEN 'accompanied_by' ELSE 'uses' END AS predicate, n.object_entity_id, NULL AS location_id, n.times, 0.8 AS confidence, n.evidence
  FROM near_ n LEFT JOIN e ON e.entity_id = n.object_entity_id
  UNION ALL SELECT subject_entity_id, 'frequents', NULL, location_id, times, 0.7, evidence FROM often_)"""


def window(extra: str = "") -> str:
    return f"ts >= {START} AND ts <= {END} {extra}"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


#: (src, dst): every id that statuses link to others, and the least id of its group where that is another.
MOVES = """ml AS (SELECT lower(entity_id) AS a, regexp_extract(lower(status), '^\\s*merged_into:\\s*(\\S+)\\s*$', 1) AS b FROM entities),
mb AS (SELECT a AS u, b AS v FROM ml WHERE b <> '' AND a <> b UNION SELECT b, a FROM ml WHERE b <> '' AND a <> b),
mv AS (SELECT * FROM (WITH RECURSIVE q AS (SELECT u AS id, u AS g FROM mb UNION SELECT mb.u, q.g FROM q JOIN mb ON mb.v = q.id)
  SELECT id AS src, min(g) AS dst FROM q GROUP BY 1) WHERE src <> dst)"""


def stable(prefix: str, *parts: str) -> str:
    """An id made of the parts, as ``stable_id`` makes it."""
    return f"'{prefix}_' || sha256(" + " || chr(31) || ".join(parts) + ")[1:12]"
