"""Queries of the filters and the query form, with the SQL they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import mining
from memlake.plans import answer as A
from memlake.plans import ladder
from memlake.plans.filters import Filters
from memlake.plans.query_plan import normalize_plan
from memlake.plans.sql import E, END, HABITS, LABELLED, O, RELATIONS, SNAPSHOTS, START, SUBJECTS, window, with_
from memlake.sources.memory import Memory

SHOWN = ["entity_id", "label", "type", "first_seen", "last_seen", "duration_s", "n_observations"]
QUERIES, ORACLE = {}, {}
ZONE = "north_ramp"


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with its SQL where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _scan(name: str, filters: Filters, where: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return Memory(spark, folder).scan(filters).select("observation_id", "seq", "subject_entity_id", "predicate", "ts", "confidence")

    query(name, with_(O) + f"SELECT observation_id, seq, subject_entity_id, predicate, ts, confidence FROM o WHERE {where}")(run)


_scan("scan_window_zone", Filters(since=START, until=END, location_ids=["loc_1a15dbff0ebd"]), window("AND location_id = 'loc_1a15dbff0ebd'"))
_scan("scan_camera_origin", Filters(camera_ids=["cam_gantry", "cam_mast"], origins=["vlm", "rule"]), "camera_id IN ('cam_gantry', 'cam_mast') AND origin IN ('vlm', 'rule')")
_scan("filter_prefix_any", Filters(predicate_prefixes=["rule_fired:", "AREA:"]), "lower(predicate) LIKE 'rule\\_fired:%' ESCAPE '\\' OR lower(predicate) LIKE 'area:%'")
_scan("filter_contains_literal", Filters(predicate_contains="_At_"), "contains(lower(predicate), '_at_')")
_scan("filter_exclude", Filters(since=START, until=END, exclude_predicates=["present", "near"], exclude_entity_ids=["scene:unknown"]), window("AND coalesce(predicate, '') NOT IN ('present', 'near') AND coalesce(subject_entity_id, '') <> 'scene:unknown'"))
_scan("filter_conf_floor", Filters(min_confidence=0.9), "confidence >= 0.9")
_scan("filter_empty_list", Filters(location_ids=[]), "false")
_scan("filter_owner", Filters(user_id="usr_1", origins=["rule"]), "(user_id IS NULL OR user_id = 'usr_1') AND origin = 'rule'")
_scan("filter_words_or_ids", Filters(predicate_contains="ladder", observation_ids=["obs_none"], match_any=True), "contains(lower(predicate), 'ladder')")


@query("scan_newest_limit", with_(O) + "SELECT observation_id, seq, ts FROM o ORDER BY ts DESC NULLS LAST, seq DESC, observation_id DESC LIMIT 50")
def scan_newest_limit(spark, folder):
    return Memory(spark, folder).scan(Filters(), "desc", 50).select("observation_id", "seq", "ts")


@query("cameras", "SELECT DISTINCT camera_id FROM (SELECT camera_id FROM observations UNION SELECT camera_id FROM locations) WHERE camera_id IS NOT NULL")
def cameras(spark, folder):
    return Memory(spark, folder).cameras()


@query("subjects", with_(E, SUBJECTS) + "SELECT entity_id, label, type FROM s")
def subjects(spark, folder):
    return Memory(spark, folder).subjects().select("entity_id", "label", "type")


def _answer_sql(where: str, subjects: str = "", tail: str = "") -> str:
    return with_(O, E, SUBJECTS) + (
        f", a AS (SELECT subject_entity_id AS entity_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n_observations"
        f" FROM o WHERE {where} GROUP BY 1)\n"
        f"SELECT entity_id, label, type, first_seen, last_seen, round_even(last_seen - first_seen, 1) AS duration_s, n_observations"
        f" FROM a JOIN s USING (entity_id) {subjects} {tail}"
    )


IN_ZONE = f"AND location_id IN (SELECT location_id FROM locations WHERE lower(name) = '{ZONE}')"


def _answer(name: str, plan: dict, where: str, subjects: str = "", tail: str = "") -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return A.answer(Memory(spark, folder), normalize_plan(plan)).entities.select(*SHOWN)

    query(name, _answer_sql(where, subjects, tail))(run)


_span = {"start": START, "end": END}
_answer("answer_who", _span | {"zones": [ZONE]}, window(IN_ZONE))
_answer("answer_who_all_time", {"intent": "who"}, "true")
_answer("answer_camera", _span | {"cameras": ["cam_gantry"]}, window("AND camera_id = 'cam_gantry'"))
_answer("answer_last_limit", _span | {"intent": "last", "order": "desc", "limit": 5}, window(), "", "ORDER BY last_seen DESC, entity_id LIMIT 5")
_answer("answer_timeline_limit", _span | {"intent": "timeline", "limit": 7}, window(), "", "ORDER BY first_seen, entity_id LIMIT 7")
_answer("answer_objects_only", _span | {"entity_type": "object"}, window(), "WHERE type = 'object'")
_answer("answer_scene_only", _span | {"entity_type": "scene"}, window(), "WHERE type = 'scene'")
_answer("answer_exclude_label", _span | {"zones": [ZONE], "exclude_entity_labels": ["Person 0", "ramp"]}, window(IN_ZONE), "WHERE NOT contains(lower(label), 'person 0') AND NOT contains(lower(label), 'ramp')")
_answer("answer_label", _span | {"entity_labels": ["Trailer", "ramp"]}, window(), "WHERE contains(lower(label), 'trailer') OR contains(lower(label), 'ramp')")
_answer("answer_unknown_zone", _span | {"zones": ["car park"]}, "false")
_answer("answer_confident", _span | {"min_confidence": 0.95, "exclude_predicates": ["present"]}, window("AND confidence >= 0.95 AND coalesce(predicate, '') <> 'present'"))
_answer("answer_predicate_contains", _span | {"predicate_contains": "rule_fired"}, window("AND contains(lower(predicate), 'rule_fired')"))


@query("answer_count", with_(O, E, SUBJECTS) + f"SELECT count(*) AS total_observations FROM o JOIN s ON s.entity_id = o.subject_entity_id WHERE {window(IN_ZONE)}")
def answer_count(spark, folder):
    return A.answer(Memory(spark, folder), normalize_plan(_span | {"intent": "count", "zones": [ZONE]})).total()


def _rows(spark, folder, plan: dict | None = None) -> tuple[Memory, DataFrame]:
    mem = Memory(spark, folder)
    return mem, A.matched_rows(mem, normalize_plan(plan or _span))


@query(
    "answer_states",
    with_(O) + f""", f AS (SELECT subject_entity_id AS entity_id, predicate, min((ts, seq)) AS at_ FROM o
WHERE {window()} AND origin = 'vlm' AND predicate NOT LIKE 'rule\\_fired:%' ESCAPE '\\' AND subject_entity_id IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY at_, predicate) AS k FROM f)
SELECT entity_id, CAST(array_to_string(list(predicate ORDER BY k), '|') AS VARCHAR) AS states FROM k WHERE k <= 8 GROUP BY 1""",
)
def answer_states(spark, folder):
    found = A.states(_rows(spark, folder)[1]).where("entity_id IS NOT NULL")
    return found.select("entity_id", F.array_join("states", "|").alias("states"))


@query(
    "diverse_keyframes",
    with_(O) + f""", f AS (SELECT subject_entity_id AS entity_id, '/keyframe/' || string_split(source_ref, '/')[-1] AS url, min(ts) AS ts FROM o
WHERE {window()} AND source_ref <> '' AND subject_entity_id IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts, url) - 1 AS i, count(*) OVER (PARTITION BY entity_id) AS n FROM f)
SELECT entity_id, array_to_string(list(url ORDER BY i), '|') AS keyframes FROM k
WHERE n <= 4 OR i IN (0, CAST(round_even((n - 1) / 3, 0) AS INT), CAST(round_even(2 * (n - 1) / 3, 0) AS INT), n - 1) GROUP BY 1""",
)
def diverse_keyframes(spark, folder):
    found = A.keyframes(_rows(spark, folder)[1]).where("entity_id IS NOT NULL")
    return found.select("entity_id", F.array_join("keyframes", "|").alias("keyframes"))


@query(
    "answer_facts",
    _answer_sql(window(IN_ZONE)).replace("SELECT entity_id, label, type, first_seen, last_seen,", "SELECT label, type, strftime(make_timestamp(CAST(first_seen * 1000000 AS BIGINT)), '%a %d %b %H:%M') AS first_seen, strftime(make_timestamp(CAST(last_seen * 1000000 AS BIGINT)), '%a %d %b %H:%M') AS last_seen,").replace("AS duration_s, n_observations FROM", "AS duration_s, n_observations, NULL AS matched_by FROM"),
)
def answer_facts(spark, folder):
    return A.facts(A.answer(Memory(spark, folder), normalize_plan(_span | {"zones": [ZONE]})).entities)


@query("answer_rule_events", with_(O) + f"SELECT subject_entity_id AS entity_id, predicate[12:] AS rule, ts, CASE WHEN source_ref <> '' THEN '/keyframe/' || string_split(source_ref, '/')[-1] END AS keyframe, observation_id FROM o WHERE {window()} AND predicate LIKE 'rule\\_fired:%' ESCAPE '\\'")
def answer_rule_events(spark, folder):
    return A.rule_events(_rows(spark, folder)[1])


_BUCKET = {
    "weekday": "lower(strftime(make_timestamp(CAST(ts * 1000000 AS BIGINT)), '%a'))",
    "hour": "strftime(make_timestamp(CAST(ts * 1000000 AS BIGINT)), '%H') || 'h'",
    "day": "strftime(make_timestamp(CAST(ts * 1000000 AS BIGINT)), '%Y-%m-%d')",
}
for _by, _sql in _BUCKET.items():

    def _recurrence(spark, folder, by=_by):
        return A.bucket_counts(_rows(spark, folder)[1], by).where("entity_id IS NOT NULL")

    query(f"recurrence_{_by}", with_(O) + f"SELECT subject_entity_id AS entity_id, {_sql} AS bucket, count(*) AS n FROM o WHERE {window()} AND subject_entity_id IS NOT NULL GROUP BY 1, 2")(_recurrence)


@query(
    "recurrence_rates",
    with_(O, E, SUBJECTS) + f""", a AS (SELECT subject_entity_id AS entity_id, count(*) AS n_sightings, count(DISTINCT {_BUCKET['day']}) AS n_occasions,
  greatest((max(ts) - min(ts)) / 86400.0, 0.0) AS span FROM o WHERE {window()} GROUP BY 1)
SELECT entity_id, n_sightings, n_occasions, round_even(span, 2) AS span_days, round_even(n_sightings / greatest(span / 7.0, 1.0), 2) AS per_week
FROM a JOIN s USING (entity_id)""",
)
def recurrence_rates(spark, folder):
    found = A.answer(Memory(spark, folder), normalize_plan(_span | {"intent": "how_often"})).recurrence
    return found.select("entity_id", "n_sightings", "n_occasions", "span_days", "per_week")


_PAIRS = "pr AS (SELECT snapshot_id, location_id, ts, entity_id, with_entity_id FROM (SELECT *, unnest(present_entity_ids) AS with_entity_id FROM (SELECT *, unnest(present_entity_ids) AS entity_id FROM sn WHERE len(present_entity_ids) >= 2)) WHERE entity_id <> with_entity_id)"
_ANCHOR = "contains(lower(label), 'trailer')"


@query("co_presence_pairs", with_(E, SUBJECTS, SNAPSHOTS, _PAIRS) + f"SELECT pr.* FROM pr JOIN s USING (entity_id) WHERE {_ANCHOR}")
def co_presence_pairs(spark, folder):
    mem = Memory(spark, folder)
    return A.present_pairs(mem.snapshots(), mem.subjects().where(F.lower("label").contains("trailer")))


@query(
    "companions",
    with_(E, SUBJECTS, SNAPSHOTS, _PAIRS) + f""", c AS (SELECT with_entity_id AS entity_id, count(DISTINCT snapshot_id) AS n_snapshots, min(ts) AS first_seen, max(ts) AS last_seen,
  count(DISTINCT entity_id) AS n_with, count(DISTINCT location_id) AS n_zones FROM pr JOIN s USING (entity_id) WHERE {_ANCHOR} GROUP BY 1)
SELECT c.*, label FROM c JOIN s USING (entity_id)""",
)
def companions(spark, folder):
    found = A.answer(Memory(spark, folder), normalize_plan({"intent": "who_with", "entity_labels": ["trailer"]})).co_presence
    return found.select("entity_id", "label", "n_snapshots", "first_seen", "last_seen", F.size("with_ids").cast("bigint").alias("n_with"), F.size("location_ids").cast("bigint").alias("n_zones"))


def _edges(mem: Memory) -> DataFrame:
    found = mining.relations(mem.scan(), mem.entities)
    return mining.reinforce(mining.empty_relations(mem.spark), found, END)


@query(
    "relations_evidence",
    with_(O, E, SUBJECTS, RELATIONS) + f""", x AS (SELECT subject_entity_id, predicate, coalesce(object_entity_id, 'scene:' || location_id) AS far_id, unnest(evidence) AS observation_id FROM rel),
y AS (SELECT x.* FROM x JOIN o USING (observation_id) WHERE {window()}),
f0 AS (SELECT DISTINCT far_id AS entity_id FROM y), f AS (SELECT * FROM {LABELLED.format('f0')})
SELECT y.subject_entity_id, y.predicate, far_id, f.label AS object_label, count(*) AS n_supporting
FROM y JOIN f ON f.entity_id = y.far_id WHERE y.subject_entity_id IN (SELECT entity_id FROM s WHERE type = 'person') GROUP BY 1, 2, 3, 4""",
)
def relations_evidence(spark, folder):
    mem = Memory(spark, folder)
    found = A.answer(mem, normalize_plan(_span | {"intent": "relations", "entity_type": "person"}), relations=_edges(mem)).relations
    return found.select("subject_entity_id", "predicate", "far_id", "object_label", "n_supporting")


@query(
    "relations_entities",
    with_(O, E, SUBJECTS, RELATIONS) + f""", x AS (SELECT coalesce(object_entity_id, 'scene:' || location_id) AS far_id, unnest(evidence) AS observation_id FROM rel),
y AS (SELECT far_id AS entity_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n_observations FROM x JOIN o USING (observation_id) WHERE {window()} GROUP BY 1),
f AS (SELECT * FROM {LABELLED.format('y')})
SELECT entity_id, label, type, first_seen, last_seen, round_even(last_seen - first_seen, 1) AS duration_s, n_observations FROM f ORDER BY n_observations DESC, first_seen, entity_id LIMIT 20""",
)
def relations_entities(spark, folder):
    mem = Memory(spark, folder)
    found = A.answer(mem, normalize_plan(_span | {"intent": "relations", "limit": 20}), relations=_edges(mem)).entities
    return found.select(*SHOWN)


def _ladder(spark: SparkSession, folder: str, plan: dict) -> DataFrame:
    """The answer of the first rung that finds something, which is told with it."""
    mem = Memory(spark, folder)
    found = ladder.execute(mem, normalize_plan(plan), lambda p, _m: A.answer(mem, p))
    step = (found.relaxation or {}).get("answered_by")
    return found.entities.select(*SHOWN, F.lit(step).cast("string").alias("answered_by"))


def _ladder_sql(where: str, step: str, subjects: str = "") -> str:
    return _answer_sql(where, subjects).replace("AS duration_s, n_observations FROM", f"AS duration_s, n_observations, {step} AS answered_by FROM")


#: A zone in which the rule asked for below doesn't fire.
LONELY = "mezzanine_stair"


@query("ladder_widened", _ladder_sql(f"ts BETWEEN {START + 0.1 - 21600} AND {START + 0.1 + 21600}", "'widen_window'"))
def ladder_widened(spark, folder):
    """A moment when nothing was seen: six hours before and after are looked at."""
    return _ladder(spark, folder, {"start": START + 0.1, "end": START + 0.1})


@query("ladder_drop_zone", _ladder_sql(window("AND contains(lower(predicate), 'rule_fired:cage_after_hours')"), "'drop_zone'"))
def ladder_drop_zone(spark, folder):
    """No such rule fires in this zone, nor in a longer window: any zone will do."""
    return _ladder(spark, folder, _span | {"predicate_contains": "rule_fired:cage_after_hours", "zones": [LONELY]})


@query("ladder_dead_end", _ladder_sql("false", "NULL"))
def ladder_dead_end(spark, folder):
    """Nothing helps: the answer stays empty and tells what was tried."""
    return _ladder(spark, folder, _span | {"cameras": ["cam_none"], "zones": [ZONE], "entity_labels": ["trailer"]})


@query("habits_hour_weekday", with_(O, HABITS) + "SELECT subject_entity_id, location_id, predicate, len(evidence) AS n_evidence, least(1.0, days / 5.0) AS confidence FROM habits")
def habits_hour_weekday(spark, folder):
    found = mining.habits(Memory(spark, folder).scan())
    return found.select("subject_entity_id", "location_id", "predicate", "n_evidence", "confidence")


@query("relations_near_frequents", with_(O, E, RELATIONS) + "SELECT subject_entity_id, predicate, object_entity_id, location_id, times, CAST(confidence AS DOUBLE) AS confidence, len(evidence) AS n_evidence FROM rel")
def relations_near_frequents(spark, folder):
    mem = Memory(spark, folder)
    return mining.relations(mem.scan(), mem.entities).select(
        "subject_entity_id", "predicate", "object_entity_id", "location_id", "times", "confidence", "n_evidence"
    )
