"""The core queries p3, p5 and p6 over the whole tables, with the SQL they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memlake.operators.rolling import trailing_totals
from memlake.operators.segments import sessions
from memlake.operators.skew import heavy_keys, key_totals
from memlake.sources.tables import load


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return sessions(load(spark, folder, "observations")).select(
        "subject_entity_id", "camera_id", "first_observation_id", "last_observation_id"
    )


def p3_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return sessions(load(spark, folder, "observations"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys(load(spark, folder, "observations"))


def p5_totals(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    return key_totals(load(spark, folder, "observations")).withColumn(
        "confidence_sum", F.round("confidence_sum", 4)
    )


def p6_trailing(spark: SparkSession, folder: str) -> DataFrame:
    return trailing_totals(load(spark, folder, "observations"))


QUERIES = {
    "p3_found": p3_found,
    "p3_sessions": p3_sessions,
    "p5_found": p5_found,
    "p5_totals": p5_totals,
    "p6_trailing": p6_trailing,
}

_ONCE = "o AS (SELECT * FROM observations QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY received_at) = 1)"

_SESSIONS = f"""
WITH {_ONCE},
s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= 1800 THEN 0 ELSE 1 END AS brk FROM o
      WHERE subject_entity_id IS NOT NULL AND camera_id IS NOT NULL AND ts IS NOT NULL
      WINDOW w AS (PARTITION BY subject_entity_id, camera_id ORDER BY ts, seq, observation_id)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY subject_entity_id, camera_id ORDER BY ts, seq, observation_id
      ROWS UNBOUNDED PRECEDING) AS isl FROM s)
SELECT subject_entity_id, camera_id, arg_min(observation_id, (ts, seq, observation_id)) AS first_observation_id,
       arg_max(observation_id, (ts, seq, observation_id)) AS last_observation_id{{more}}
FROM i GROUP BY subject_entity_id, camera_id, isl"""

_TOTALS = f"""
WITH {_ONCE},
k AS (SELECT 'subject_entity_id' AS key_field, subject_entity_id AS key_value, confidence, ts FROM o
      UNION ALL SELECT 'location_id', location_id, confidence, ts FROM o)
SELECT key_field, key_value{{more}} FROM k WHERE key_value IS NOT NULL GROUP BY 1, 2 {{having}}"""

ORACLE = {
    "p3_found": _SESSIONS.format(more=""),
    "p3_sessions": _SESSIONS.format(
        more=", min(ts) AS start_ts, max(ts) AS end_ts, max(ts) - min(ts) AS duration_s, count(*) AS n_events"
    ),
    "p5_found": _TOTALS.format(more="", having="HAVING count(*) > 0.05 * (SELECT count(*) FROM o)"),
    "p5_totals": _TOTALS.format(
        more=", count(*) AS n, round(sum(confidence), 4) AS confidence_sum, min(ts) AS first_ts, max(ts) AS last_ts",
        having="",
    ),
    "p6_trailing": f"""
WITH {_ONCE},
d AS (SELECT subject_entity_id, CAST(floor(ts / 86400) AS INT) AS d, count(*) AS n,
             count(*) FILTER (confidence BETWEEN 0 AND 1) AS nc,
             sum(confidence) FILTER (confidence BETWEEN 0 AND 1) AS sc
      FROM o WHERE subject_entity_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
c AS (SELECT subject_entity_id, unnest(generate_series(min(d), max(d))) AS day FROM d GROUP BY 1),
j AS (SELECT c.subject_entity_id, c.day,
             coalesce(sum(n) FILTER (c.day - d < 7), 0) AS n7, coalesce(sum(nc) FILTER (c.day - d < 7), 0) AS nc7,
             coalesce(sum(sc) FILTER (c.day - d < 7), 0) AS sc7,
             coalesce(sum(n), 0) AS n30, coalesce(sum(nc), 0) AS nc30, coalesce(sum(sc), 0) AS sc30
      FROM c LEFT JOIN d ON d.subject_entity_id = c.subject_entity_id AND d.d BETWEEN c.day - 29 AND c.day
      GROUP BY 1, 2)
SELECT subject_entity_id, DATE '1970-01-01' + CAST(day AS INT) AS day,
       CAST(n7 AS BIGINT) AS n_7d, round(sc7, 6) AS confidence_sum_7d,
       CASE WHEN nc7 > 0 THEN round(sc7, 6) / nc7 END AS confidence_avg_7d,
       CAST(n30 AS BIGINT) AS n_30d, round(sc30, 6) AS confidence_sum_30d,
       CASE WHEN nc30 > 0 THEN round(sc30, 6) / nc30 END AS confidence_avg_30d
FROM j""",
}
