"""Queries of mining, dashboards, search, identity, corrections, reports and the live operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import analytics, corrections, digest, identity, lexical, mining, ranking, reports, semantic
from memlake.plans import retrieval
from memlake.plans.filters import Filters
from memlake.plans.query_plan import normalize_plan
from memlake.plans.sql import E, END, HABITS, MOVES, O, RELATIONS, SNAPSHOTS, START, T0, stable, window, with_
from memlake.scratch import fresh_path
from memlake.sources.files import split_classes
from memlake.sources.memory import Memory
from memlake.sources.tables import load

from memlake.streaming import pipeline

QUERIES, ORACLE = {}, {}
NOW = T0 + 60 * 86400


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with its SQL where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


# --- mining --------------------------------------------------------------------

_CHANGES = """p AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY ts, snapshot_id) AS i,
  row_number() OVER (PARTITION BY location_id ORDER BY ts DESC, snapshot_id DESC) AS j, count(*) OVER (PARTITION BY location_id) AS cnt FROM sn),
m AS (SELECT location_id, snapshot_id, ts, i, j, cnt, unnest(present_entity_ids) AS entity_id FROM p WHERE cnt >= 2),
g AS (SELECT location_id, entity_id, min(i) AS first, min(j) AS last, arg_min(ts, i) AS first_ts FROM m GROUP BY 1, 2),
z AS (SELECT location_id, max(ts) AS end_ts FROM p GROUP BY 1),
ch AS (SELECT location_id, entity_id, 'new' AS kind, first_ts AS ts FROM g WHERE first > 1
  UNION ALL SELECT location_id, entity_id, 'gone', end_ts FROM g JOIN z USING (location_id) WHERE last > 3)"""


@query("change_new_gone", with_(SNAPSHOTS, _CHANGES) + "SELECT * FROM ch")
def change_new_gone(spark, folder):
    return mining.changes(Memory(spark, folder).snapshots()).drop("evidence")


@query(
    "change_events",
    with_(E, SNAPSHOTS, _CHANGES) + """SELECT entity_id AS subject_entity_id, location_id, CASE WHEN type = 'object' AND kind = 'new' THEN 'acquired'
  WHEN type = 'object' THEN 'removed' ELSE 'appeared' END AS predicate FROM ch JOIN e USING (entity_id) WHERE type = 'object' OR (type = 'person' AND kind = 'new')""",
)
def change_events(spark, folder):
    mem = Memory(spark, folder)
    return mining.change_events(mining.changes(mem.snapshots()), mem.entities).select("subject_entity_id", "location_id", "predicate")


_CANDIDATES = """cand AS (SELECT 'habit' AS kind, subject_entity_id, predicate, CAST(NULL AS VARCHAR) AS object_entity_id, location_id, 1 AS times, least(1.0, days / 5.0) AS confidence, evidence FROM habits
  UNION ALL SELECT 'relation', subject_entity_id, predicate, object_entity_id, location_id, times, confidence, evidence FROM rel)"""
_WEIGHT = "least(1.0, 0.0 + 0.15 * greatest(0.0, least(1.0, confidence)) * greatest(1, times))"


def _mined(mem: Memory, now: float = NOW, passes: int = 1) -> DataFrame:
    """The edges after some passes over the same rows."""
    rows = mem.scan()
    found = mining.habits(rows).unionByName(mining.relations(rows, mem.entities)).withColumn("times", F.col("times") * passes)
    return mining.reinforce(mining.empty_relations(mem.spark), found, now)


@query(
    "reinforce_weights",
    with_(O, E, HABITS, RELATIONS, _CANDIDATES) + f"SELECT kind, subject_entity_id, predicate, object_entity_id, location_id, round({_WEIGHT}, 9) AS weight, CASE WHEN {_WEIGHT} >= 0.6 THEN 'confirmed' ELSE 'candidate' END AS status, len(evidence) AS n_evidence FROM cand",
)
def reinforce_weights(spark, folder):
    return _mined(Memory(spark, folder)).select(
        "kind", "subject_entity_id", "predicate", "object_entity_id", "location_id", F.round("weight", 9).alias("weight"), "status",
        "n_evidence",
    )


@query(
    "decay_weights",
    with_(O, E, HABITS, RELATIONS, _CANDIDATES) + f"SELECT kind, subject_entity_id, predicate, object_entity_id, location_id, round({_WEIGHT} * power(0.5, 10.0 / 14.0), 9) AS weight, CASE WHEN {_WEIGHT} * power(0.5, 10.0 / 14.0) >= 0.6 THEN 'confirmed' ELSE 'candidate' END AS status FROM cand",
)
def decay_weights(spark, folder):
    return mining.decay(_mined(Memory(spark, folder)), NOW + 10 * 86400).select(
        "kind", "subject_entity_id", "predicate", "object_entity_id", "location_id", F.round("weight", 9).alias("weight"), "status"
    )


@query("evidence_rows", with_(O, E, HABITS, RELATIONS, _CANDIDATES) + "SELECT kind, predicate, subject_entity_id, object_entity_id, location_id, unnest(evidence) AS observation_id FROM cand")
def evidence_rows(spark, folder):
    """What the edges rest on, one row each."""
    mem = Memory(spark, folder)
    rows = mem.scan()
    edges = mining.habits(rows).unionByName(mining.relations(rows, mem.entities))
    return mining.evidence_rows(rows, edges.select(*mining.KEY))


_REL_ID = stable("rel", "kind", "subject_entity_id", "predicate", "coalesce(object_entity_id, '')", "coalesce(location_id, '')")


@query(
    "distil_pass",
    with_(O.replace("o AS (SELECT * FROM observations QUALIFY", "o AS (SELECT * FROM observations WHERE ts IS NOT NULL QUALIFY"), E, HABITS, RELATIONS, SNAPSHOTS, _CHANGES, _CANDIDATES)
    + f""", al AS (SELECT kind, subject_entity_id, predicate, object_entity_id, location_id, times, confidence, len(evidence) AS n FROM cand
  UNION ALL SELECT 'event', entity_id, CASE WHEN type = 'object' AND kind = 'new' THEN 'acquired' WHEN type = 'object' THEN 'removed' ELSE 'appeared' END, NULL, location_id, 1, 0.5,
    CASE WHEN kind = 'new' THEN 1 ELSE least(3, (SELECT count(*) FROM sn WHERE sn.location_id = ch.location_id)) END FROM ch JOIN e USING (entity_id) WHERE type = 'object' OR (type = 'person' AND kind = 'new'))
SELECT {_REL_ID} AS relation_id, kind, subject_entity_id, predicate, object_entity_id, location_id, round({_WEIGHT}, 9) AS weight, n AS n_evidence, {NOW} AS last_reinforced_at, {NOW} AS created_at,
  CASE WHEN {_WEIGHT} >= 0.6 THEN 'confirmed' ELSE 'candidate' END AS status FROM al""",
)
def distil_pass(spark, folder):
    """A whole pass over the memory: habits, relations and change events of the window."""
    mem = Memory(spark, folder)
    found = mining.distil(mining.empty_relations(spark), mem.scan(), mem.entities, mem.snapshots(), NOW)
    return found.drop("supporting_observation_ids").withColumn("weight", F.round("weight", 9))


@query("mining_window", with_(O) + f"SELECT count(*) AS n FROM o WHERE ts >= (SELECT max(ts) FROM observations) - {20 * 86400}.0")
def mining_window(spark, folder):
    mem = Memory(spark, folder)
    return mining.mining_window(mem.observations, 20).dropDuplicates(["observation_id"]).agg(F.count(F.lit(1)).alias("n"))


@query("canonical_predicates", with_(O, "c AS (SELECT predicate, min(canonical) AS canonical FROM predicate_schema WHERE canonical IS NOT NULL GROUP BY 1)") + "SELECT coalesce(c.canonical, predicate) AS predicate, count(*) AS n FROM o LEFT JOIN c USING (predicate) WHERE predicate IS NOT NULL GROUP BY 1")
def canonical_predicates(spark, folder):
    mem = Memory(spark, folder)
    found = mining.canonicalised(mem.scan().select("predicate"), mem.table("predicate_schema"))
    return found.where("predicate IS NOT NULL").groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


@query(
    "legal_triples",
    with_(O, E) + """, t AS (SELECT DISTINCT s.type AS subject_type, o.predicate, b.type AS object_type FROM o JOIN e s ON s.entity_id = o.subject_entity_id LEFT JOIN e b ON b.entity_id = o.object_entity_id WHERE o.predicate IS NOT NULL)
SELECT t.subject_type, t.predicate, t.object_type, coalesce(bool_or(CASE WHEN p.predicate IS NOT NULL THEN
  coalesce((p.subject_type = 'any' OR p.subject_type = t.subject_type) AND (p.object_type = 'any' OR p.object_type IS NOT DISTINCT FROM t.object_type), false) END), true) AS legal
FROM t LEFT JOIN predicate_schema p ON p.predicate = t.predicate GROUP BY 1, 2, 3""",
)
def legal_triples(spark, folder):
    mem = Memory(spark, folder)
    who = mem.entities
    rows = (
        mem.scan().where("predicate IS NOT NULL")
        .join(who.select(F.col("entity_id").alias("subject_entity_id"), F.col("type").alias("subject_type")), "subject_entity_id")
        .join(who.select(F.col("entity_id").alias("object_entity_id"), F.col("type").alias("object_type")), "object_entity_id", "left")
        .select("subject_type", "predicate", "object_type").distinct()
    )
    return mining.legal_triples(rows, mem.table("predicate_schema"))


# --- dashboards ----------------------------------------------------------------


@query("appearances", with_(O) + "SELECT subject_entity_id AS entity_id, count(*) AS n, max(ts) AS last_seen, arg_max(source_ref, (ts, seq)) FILTER (source_ref IS NOT NULL AND ts IS NOT NULL) AS keyframe FROM o WHERE subject_entity_id IS NOT NULL GROUP BY 1")
def appearances(spark, folder):
    rows = Memory(spark, folder).scan().where("subject_entity_id IS NOT NULL")
    with_ts = rows.withColumn("source_ref", F.when(F.col("ts").isNotNull(), F.col("source_ref")))
    return analytics.appearances(with_ts)


@query(
    "entity_cards",
    with_(O, E) + f""", a AS (SELECT subject_entity_id AS entity_id, count(*) AS n, max(ts) AS last_seen FROM o GROUP BY 1),
x AS (SELECT e.entity_id, e.type, e.label, coalesce(n, 0) AS times_seen, last_seen, coalesce(n, 0) / greatest(({NOW} - created_at) / 86400.0, 1.0) AS rate FROM e LEFT JOIN a USING (entity_id) WHERE lower(trim(status)) = 'active')
SELECT entity_id, type, label, times_seen, last_seen, CASE WHEN rate >= 3 THEN 'high' WHEN rate >= 0.5 THEN 'med' ELSE 'low' END AS frequency FROM x""",
)
def entity_cards(spark, folder):
    mem = Memory(spark, folder)
    return analytics.entity_cards(mem.active, mem.scan(), NOW).drop("keyframe")


@query("kpis", with_(O, E) + "SELECT (SELECT count(*) FROM e WHERE lower(trim(status)) = 'active' AND type = 'person') AS total_persons, (SELECT count(*) FROM e WHERE lower(trim(status)) = 'active' AND type = 'object') AS total_objects, count(*) AS total_observations FROM o")
def kpis(spark, folder):
    mem = Memory(spark, folder)
    return analytics.kpis(mem.entities, mem.scan())


@query("per_camera", with_(O) + "SELECT camera_id, count(*) AS n FROM o WHERE camera_id IS NOT NULL GROUP BY 1")
def per_camera(spark, folder):
    return analytics.per_camera(Memory(spark, folder).scan())


@query("stats_hourly", with_(O) + f"SELECT CAST(floor(ts / 3600) * 3600 AS BIGINT) AS hour, count(*) AS n FROM o WHERE ts >= {END} GROUP BY 1")
def stats_hourly(spark, folder):
    return analytics.hourly(Memory(spark, folder).scan(), END)


_EVENTS = f"""ev AS (SELECT o.*, e.type AS entity_type, CASE WHEN origin = 'rule' THEN 'fired' WHEN e.created_at >= {START} THEN 'unusual' ELSE 'routine' END AS cls
  FROM o LEFT JOIN e ON e.entity_id = o.subject_entity_id WHERE ts BETWEEN {START} AND {END})"""


def _events(mem: Memory) -> DataFrame:
    return analytics.classified(mem.scan(Filters(since=START, until=END)), mem.entities, START, END)


@query("timeline_bins", with_(O, E, _EVENTS) + f"SELECT b.bin, count(*) FILTER (cls = 'fired') AS fired, count(*) FILTER (cls = 'unusual') AS unusual, count(*) FILTER (cls = 'routine') AS routine FROM (SELECT unnest(range(48)) AS bin) b LEFT JOIN (SELECT *, least(47, greatest(0, floor((ts - {START}) / {END - START} * 48))) AS k FROM ev) ON k = b.bin GROUP BY 1")
def timeline_bins(spark, folder):
    return analytics.timeline(_events(Memory(spark, folder)), START, END)


@query("timeline_persons", with_(O, E, _EVENTS) + f"SELECT b.bin, count(*) FILTER (cls = 'fired') AS fired, count(*) FILTER (cls = 'unusual') AS unusual, count(*) FILTER (cls = 'routine') AS routine FROM (SELECT unnest(range(24)) AS bin) b LEFT JOIN (SELECT *, least(23, greatest(0, floor((ts - {START}) / {END - START} * 24))) AS k FROM ev WHERE entity_type = 'person') ON k = b.bin GROUP BY 1")
def timeline_persons(spark, folder):
    return analytics.timeline(_events(Memory(spark, folder)), START, END, 24, "person")


@query("timeline_chips", with_(O, E, _EVENTS) + "SELECT count(*) AS \"all\", count(*) FILTER (cls = 'fired') AS alerts, count(*) FILTER (entity_type = 'person') AS person, count(*) FILTER (entity_type = 'object') AS object FROM ev")
def timeline_chips(spark, folder):
    return analytics.timeline_chips(_events(Memory(spark, folder)))


_RULES = [("linger_at_ramp", "high"), ("cage_after_hours", "critical"), ("blocked_hatch", "Low")]
_ALERTS = """al AS (SELECT observation_id AS id, CASE WHEN predicate LIKE 'rule\\_fired:%' ESCAPE '\\' THEN predicate[12:] ELSE predicate END AS rule, coalesce(status, 'new') AS status,
  CASE WHEN predicate = 'rule_fired:linger_at_ramp' THEN 'high' WHEN predicate = 'rule_fired:cage_after_hours' THEN 'critical' WHEN predicate = 'rule_fired:blocked_hatch' THEN 'low' ELSE 'medium' END AS severity, camera_id AS camera, ts, subject_entity_id AS entity_id FROM o WHERE origin = 'rule')"""


def _alerts(mem: Memory) -> DataFrame:
    return analytics.alerts(mem.scan(Filters(origins=["rule"])), mem.spark.createDataFrame(_RULES, "name string, severity string"))


@query("alerts", with_(O, _ALERTS) + "SELECT * FROM al")
def alerts(spark, folder):
    return _alerts(Memory(spark, folder)).select("id", "rule", "status", "severity", "camera", "ts", "entity_id")


@query(
    "alerts_facets",
    with_(O, _ALERTS) + "SELECT 'all' AS dimension, 'all' AS value, count(*) AS n FROM al WHERE severity = 'high' AND status = 'new'"
    + "".join(f" UNION ALL SELECT 'status', '{s}', count(*) FROM al WHERE severity = 'high' AND status = '{s}'" for s in analytics.ALERT_STATUSES)
    + "".join(f" UNION ALL SELECT 'severity', '{s}', count(*) FROM al WHERE status = 'new' AND severity = '{s}'" for s in analytics.SEVERITIES),
)
def alerts_facets(spark, folder):
    return analytics.facets(
        _alerts(Memory(spark, folder)), {"status": analytics.ALERT_STATUSES, "severity": analytics.SEVERITIES}, {"status": "new", "severity": "high"}
    )


def _chat(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Threads and turns made of the event stream: a user's events are the turns of a thread."""
    rows = spark.read.parquet(f"{folder}/events.parquet")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    turns = rows.select(
        F.concat(F.lit("turn_"), "event_id").alias("turn_id"), F.concat(F.lit("conv_"), "user_id").alias("conversation_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("asked_at"), F.bround("value").cast("int").alias("latency_ms"),
        (k % 5).alias("n_entities"), k.alias("n_observations"), (k % 3).alias("n_keyframes"), (k % 2).alias("n_rule_events"),
    )
    threads = turns.groupBy("conversation_id").agg(F.max("asked_at").alias("updated_at"), F.lit("usr").alias("user_id"))
    return threads, turns


_CHAT = """tu AS (SELECT 'conv_' || user_id AS conversation_id, epoch_us(ts) AS asked_at, CAST(round_even(value, 0) AS INT) AS latency_ms, coalesce(CAST(props->>'$.k' AS INT), 0) AS k FROM events)"""


@query("chat_kpis", with_(_CHAT) + "SELECT count(DISTINCT conversation_id) AS threads, count(*) AS questions, CAST(sum(k % 5) AS BIGINT) AS entities, CAST(sum(k) AS BIGINT) AS observations, CAST(sum(k % 3) AS BIGINT) AS keyframes, CAST(sum(k % 2) AS BIGINT) AS rule_events, CAST(round_even(avg(latency_ms), 0) AS BIGINT) AS avg_latency_ms, max(asked_at) AS last_asked FROM tu")
def chat_kpis(spark, folder):
    return analytics.chat_kpis(*_chat(spark, folder))


@query("conversation_list", with_(_CHAT) + "SELECT conversation_id, count(*) AS n_turns, max(asked_at) AS last_asked FROM tu GROUP BY 1 ORDER BY max(asked_at) DESC, conversation_id LIMIT 200")
def conversation_list(spark, folder):
    return analytics.conversation_list(*_chat(spark, folder)).select("conversation_id", "n_turns", "last_asked")


@query("conversation_page", with_(_CHAT) + "SELECT conversation_id, count(*) AS n_turns, max(asked_at) AS last_asked FROM tu GROUP BY 1 ORDER BY max(asked_at) DESC, conversation_id LIMIT 50 OFFSET 25")
def conversation_page(spark, folder):
    return analytics.conversation_list(*_chat(spark, folder), limit=50, offset=25).select("conversation_id", "n_turns", "last_asked")


@query("answer_counts", with_(O) + f"SELECT count(DISTINCT subject_entity_id) AS n_entities, count(*) AS n_observations, count(DISTINCT source_ref) AS n_keyframes, count(*) FILTER (predicate LIKE 'rule\\_fired:%' ESCAPE '\\') AS n_rule_events FROM o WHERE {window()}")
def answer_counts(spark, folder):
    return analytics.answer_counts(Memory(spark, folder).scan(Filters(since=START, until=END)))


@query("case_list", """WITH c AS (SELECT DISTINCT 'case_' || c_nationkey AS case_id, c_nationkey AS k FROM customer),
i AS (SELECT 'case_' || c_nationkey AS case_id, ['entity', 'alert', 'event'][c_custkey % 3 + 1] AS kind FROM customer WHERE c_nationkey % 4 <> 0)
SELECT c.case_id, k AS updated_at, count(i.kind) AS n_items, count(*) FILTER (kind = 'entity') AS n_entity, count(*) FILTER (kind = 'alert') AS n_alert, count(*) FILTER (kind = 'event') AS n_event
FROM c LEFT JOIN i USING (case_id) GROUP BY 1, 2 ORDER BY 2 DESC LIMIT 20""")
def case_list(spark, folder):
    """Cases made of nations, their items of customers; every fourth case is empty."""
    rows = spark.read.parquet(f"{folder}/customer.parquet").withColumn("case_id", F.concat(F.lit("case_"), "c_nationkey"))
    kind = F.element_at(F.array(F.lit("entity"), F.lit("alert"), F.lit("event")), (F.col("c_custkey") % 3 + 1).cast("int"))
    items = rows.where("c_nationkey % 4 != 0").select("case_id", kind.alias("kind"))
    return analytics.case_list(rows.select("case_id", F.col("c_nationkey").alias("updated_at")).distinct(), items, limit=20)


@query(
    "map_markers",
    with_(O, E) + f""", r AS (SELECT * FROM o WHERE ts >= {END}),
la AS (SELECT subject_entity_id AS entity_id, arg_max({{'c': camera_id, 'l': location_id, 't': ts}}, (ts, seq)) AS m FROM r WHERE subject_entity_id IS NOT NULL GROUP BY 1),
mk AS (SELECT coalesce(e.type, 'object') AS kind, la.entity_id AS id, coalesce(nullif(e.label, ''), upper(coalesce(e.type, 'entity')[1]) || lower(coalesce(e.type, 'entity')[2:]) || ' ' || right(la.entity_id, 6)) AS label,
  la.entity_id, m.c AS camera_id, m.l AS location_id, m.t AS ts FROM la LEFT JOIN e USING (entity_id)
  UNION ALL SELECT 'alert', observation_id, replace(CASE WHEN predicate LIKE 'rule\\_fired:%' ESCAPE '\\' THEN predicate[12:] ELSE predicate END, '_', ' '), subject_entity_id, camera_id, location_id, ts FROM r WHERE origin = 'rule' AND coalesce(status, 'new') <> 'resolved')
SELECT kind, id, label, mk.entity_id, coalesce(l.camera_id, mk.camera_id) AS camera_id, mk.location_id, ts, l.name AS zone_name FROM mk LEFT JOIN locations l USING (location_id)""",
)
def map_markers(spark, folder):
    mem = Memory(spark, folder)
    return analytics.map_markers(mem.scan(Filters(since=END)), mem.entities, mem.locations, END).drop("cx", "cy")


_SURE = "sure AS (SELECT * FROM (SELECT * REPLACE (times * 6 AS times) FROM cand) WHERE " + _WEIGHT + " >= 0.6)"


@query(
    "graph_edges",
    with_(O, E, HABITS, RELATIONS, _CANDIDATES, _SURE) + """SELECT concat_ws('|', subject_entity_id, predicate, coalesce(object_entity_id, location_id)) AS id, subject_entity_id AS "from",
  coalesce(object_entity_id, location_id) AS "to", predicate AS label, kind = 'habit' AS dashes FROM sure WHERE (kind = 'relation' AND object_entity_id IS NOT NULL) OR kind = 'habit'""",
)
def graph_edges(spark, folder):
    """What six passes have confirmed."""
    return analytics.graph_edges(_mined(Memory(spark, folder), passes=6)).drop("t")


@query(
    "graph_nodes",
    with_(O, E, HABITS, RELATIONS, _CANDIDATES, _SURE) + """SELECT entity_id AS id, coalesce(nullif(label, ''), CASE WHEN type = 'person' THEN 'Unknown Person' ELSE 'Unknown Object' END) AS label,
  CASE WHEN type = 'person' THEN 'person' ELSE 'object' END AS "group" FROM e WHERE lower(trim(status)) = 'active'
UNION ALL SELECT DISTINCT location_id, location_id, 'location' FROM sure WHERE kind = 'habit'""",
)
def graph_nodes(spark, folder):
    mem = Memory(spark, folder)
    return analytics.graph_nodes(mem.active, analytics.graph_edges(_mined(mem, passes=6)))


@query("zones_by_camera", "SELECT camera_id, array_to_string(list_sort(list(name) FILTER (name IS NOT NULL)), '|') AS zones FROM (SELECT camera_id, name FROM locations UNION ALL SELECT DISTINCT camera_id, NULL FROM observations WHERE camera_id IS NOT NULL AND camera_id NOT IN (SELECT camera_id FROM locations WHERE camera_id IS NOT NULL)) GROUP BY 1")
def zones_by_camera(spark, folder):
    mem = Memory(spark, folder)
    found = analytics.zones_by_camera(mem.locations, mem.cameras())
    return found.select("camera_id", F.when(F.size("zones") > 0, F.array_join("zones", "|")).alias("zones"))


@query("camera_liveness", with_(O) + f"SELECT camera_id, max(ts) AS last_frame_ts, {NOW} - max(ts) < 3600 AS up FROM o WHERE camera_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1")
def camera_liveness(spark, folder):
    return analytics.liveness(Memory(spark, folder).scan().where("camera_id IS NOT NULL AND ts IS NOT NULL"), NOW, 3600)


@query(
    "inspect_entities",
    with_(O, E) + """, s AS (SELECT * FROM signatures QUALIFY row_number() OVER (PARTITION BY sig_id ORDER BY created_at) = 1),
c AS (SELECT subject_entity_id AS entity_id, count(*) AS n FROM o GROUP BY 1),
k AS (SELECT entity_id, count(*) FILTER (kind = 'face') AS f, count(*) FILTER (kind = 'body') AS b, count(*) FILTER (kind = 'appearance') AS a FROM s GROUP BY 1)
SELECT entity_id, type, label, status, coalesce(n, 0) AS n_observations, coalesce(f, 0) AS n_face, coalesce(b, 0) AS n_body, coalesce(a, 0) AS n_appearance FROM e LEFT JOIN c USING (entity_id) LEFT JOIN k USING (entity_id)""",
)
def inspect_entities(spark, folder):
    mem = Memory(spark, folder)
    return analytics.inspect(mem.entities, mem.scan(), mem.table("signatures").dropDuplicates(["sig_id"]))


@query(
    "inventory_asof",
    with_(O, SNAPSHOTS) + """, q AS (SELECT observation_id AS probe_id, location_id, ts FROM o WHERE origin = 'rule' AND location_id IS NOT NULL AND ts IS NOT NULL)
SELECT probe_id, q.location_id, q.ts, coalesce(array_to_string(sn.present_entity_ids, '|'), '') AS present FROM q ASOF LEFT JOIN sn ON sn.location_id = q.location_id AND sn.ts <= q.ts""",
)
def inventory_asof(spark, folder):
    mem = Memory(spark, folder)
    probes = mem.scan(Filters(origins=["rule"])).where("location_id IS NOT NULL AND ts IS NOT NULL")
    found = analytics.inventory_asof(mem.snapshots(), probes.select(F.col("observation_id").alias("probe_id"), "location_id", "ts"))
    return found.select("probe_id", "location_id", "ts", F.array_join("present_entity_ids", "|").alias("present"))


@query(
    "evidence_interval_10s",
    with_(O) + """, f AS (SELECT subject_entity_id AS entity_id, min(ts) AS t FROM o WHERE subject_entity_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1)
SELECT f.entity_id, arg_min(o.source_ref, (o.ts, o.seq)) AS source_ref FROM f JOIN o ON o.ts BETWEEN f.t - 10 AND f.t + 10 AND o.source_ref IS NOT NULL GROUP BY 1""",
)
def evidence_interval_10s(spark, folder):
    rows = Memory(spark, folder).scan()
    firsts = rows.where("subject_entity_id IS NOT NULL AND ts IS NOT NULL").groupBy(F.col("subject_entity_id").alias("entity_id")).agg(F.min("ts").alias("ts"))
    return analytics.evidence_near(rows, firsts)


# --- digest --------------------------------------------------------------------

_HOUR = "CAST(strftime(make_timestamp(CAST(ts * 1000000 AS BIGINT)), '%H') AS INT)"


@query(
    "unusual_hours",
    with_(O, HABITS) + f""", hh AS (SELECT subject_entity_id, location_id, list_sort(list(DISTINCT CAST(regexp_extract(predicate, '^present_around_(\\d+)h$', 1) AS INT))) AS hours FROM habits WHERE predicate LIKE 'present\\_around\\_%' ESCAPE '\\' GROUP BY 1, 2),
x AS (SELECT subject_entity_id, location_id, {_HOUR} AS h, min(ts) AS ts FROM o WHERE {window()} AND predicate = 'present' AND location_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT x.subject_entity_id, x.location_id, h, x.ts FROM x JOIN hh USING (subject_entity_id, location_id) WHERE len(list_filter(hours, lambda y: abs(h - y) <= 1 OR abs(h - y) >= 23)) = 0""",
)
def unusual_hours(spark, folder):
    mem = Memory(spark, folder)
    rel = mining.reinforce(mining.empty_relations(spark), mining.habits(mem.scan()), NOW)
    return digest.unusual_hours(mem.scan(Filters(since=START, until=END)), rel).select("subject_entity_id", "location_id", "h", "ts")


_ITEMS = f"""hh AS (SELECT subject_entity_id, location_id, list_sort(list(DISTINCT CAST(regexp_extract(predicate, '^present_around_(\\d+)h$', 1) AS INT))) AS hours FROM habits WHERE predicate LIKE 'present\\_around\\_%' ESCAPE '\\' GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN predicate LIKE 'rule\\_fired:%' ESCAPE '\\' THEN predicate[12:] ELSE predicate END AS rule FROM o WHERE {window()}),
kf AS (SELECT subject_entity_id AS entity_id, min(ts) AS t, arg_min(source_ref, (ts, seq)) FILTER (source_ref IS NOT NULL) AS own FROM o WHERE subject_entity_id IS NOT NULL GROUP BY 1),
nr AS (SELECT kf.entity_id, arg_min(x.source_ref, (x.ts, x.seq)) AS source_ref FROM kf JOIN r x ON x.ts BETWEEN kf.t - 10 AND kf.t + 10 AND x.source_ref IS NOT NULL WHERE own IS NULL GROUP BY 1),
ff AS (SELECT subject_entity_id AS entity_id, arg_min(coalesce(location_id, ''), (ts, seq)) AS place FROM o WHERE ts IS NOT NULL GROUP BY 1),
u AS (SELECT subject_entity_id, location_id, {_HOUR} AS h, arg_min({{'ts': ts, 'ref': coalesce(source_ref, '')}}, (ts, seq)) AS f FROM r WHERE predicate = 'present' AND location_id IS NOT NULL GROUP BY 1, 2, 3),
i0 AS (SELECT concat_ws(':', 'rule', rule, subject_entity_id, CAST(CAST(floor(ts) AS BIGINT) AS VARCHAR)) AS signature, 'rule_fired' AS band, subject_entity_id AS entity_id, 'Rule fired: ' || rule AS title, ts, location_id, source_ref FROM r WHERE origin = 'rule'
  UNION ALL SELECT 'first_seen:' || entity_id, 'unusual', entity_id, 'First time seen', created_at, nullif(place, ''), coalesce(own, nr.source_ref) FROM e LEFT JOIN ff USING (entity_id) LEFT JOIN kf USING (entity_id) LEFT JOIN nr USING (entity_id)
    WHERE lower(trim(status)) = 'active' AND created_at BETWEEN {START} AND {END}
  UNION ALL SELECT printf('unusual_hour:%s:%s:%02d', subject_entity_id, location_id, h), 'unusual', subject_entity_id, printf('Present at unusual hour (%02dh local; habit hours: [%s])', h, array_to_string(hours, ', ')), f.ts, location_id, nullif(f.ref, '')
    FROM u JOIN hh USING (subject_entity_id, location_id) WHERE len(list_filter(hours, lambda y: abs(h - y) <= 1 OR abs(h - y) >= 23)) = 0),
tr AS (SELECT DISTINCT regexp_extract(predicate, '^digest:[a-z]+:(.*)$', 1) AS signature FROM o WHERE regexp_matches(predicate, '^digest:(dismissed|confirmed):')),
it AS (SELECT signature, i0.entity_id, band, title, i0.ts, CASE WHEN source_ref <> '' THEN '/keyframe/' || string_split(source_ref, '/')[-1] END AS keyframe,
  coalesce(nullif(label, ''), upper(coalesce(type, 'entity')[1]) || lower(coalesce(type, 'entity')[2:]) || ' ' || right(i0.entity_id, 6)) AS label, l.name AS location
  FROM i0 LEFT JOIN e USING (entity_id) LEFT JOIN locations l USING (location_id) WHERE signature NOT IN (SELECT signature FROM tr))"""


def _digest(mem: Memory):
    return digest.build(mem.scan(), mem.entities, mem.active, mem.locations, _mined(mem, START + 1), START, END)


@query("digest_items", with_(O, E, HABITS, _ITEMS) + "SELECT * FROM it")
def digest_items(spark, folder):
    return _digest(Memory(spark, folder)).items


@query("digest_rule_items", with_(O) + f"SELECT concat_ws(':', 'rule', r, subject_entity_id, CAST(CAST(floor(ts) AS BIGINT) AS VARCHAR)) AS signature, subject_entity_id AS entity_id, 'Rule fired: ' || r AS title, ts FROM (SELECT *, CASE WHEN predicate LIKE 'rule\\_fired:%' ESCAPE '\\' THEN predicate[12:] ELSE predicate END AS r FROM o WHERE {window()} AND origin = 'rule')")
def digest_rule_items(spark, folder):
    return digest.fired_items(Memory(spark, folder).scan(Filters(since=START, until=END))).select("signature", "entity_id", "title", "ts")


@query("digest_routine", with_(O) + f"SELECT count(*) FILTER (origin IS DISTINCT FROM 'rule') AS observations, count(DISTINCT subject_entity_id) AS entities FROM o WHERE {window()}")
def digest_routine(spark, folder):
    return _digest(Memory(spark, folder)).routine


@query(
    "digest_histogram",
    with_(O, E, HABITS, _ITEMS) + f""", c AS (SELECT CAST(least(29, greatest(0, floor((ts - {START}) / {(END - START) / 30}))) AS INT) AS bin, count(*) AS n FROM r GROUP BY 1),
m AS (SELECT CAST(least(29, greatest(0, floor((ts - {START}) / {(END - START) / 30}))) AS INT) AS bin, bool_or(band = 'rule_fired') AS fired FROM it GROUP BY 1)
SELECT bin, coalesce(n, 0) AS count, CASE WHEN fired THEN 'f' WHEN fired IS NOT NULL THEN 'u' ELSE 'r' END AS type FROM (SELECT CAST(unnest(range(30)) AS INT) AS bin) LEFT JOIN c USING (bin) LEFT JOIN m USING (bin)""",
)
def digest_histogram(spark, folder):
    return _digest(Memory(spark, folder)).histogram


# --- search --------------------------------------------------------------------

_TOKENS = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')"
_BM25 = f"""d AS (SELECT description_id AS doc_id, {_TOKENS} AS t FROM scene_descriptions),
c AS (SELECT count(*) AS n, sum(coalesce(len(t), 0)) / count(*) AS avgdl FROM d),
w AS (SELECT doc_id, len(t) AS dl, q.term, len(list_filter(t, lambda x: x = q.term)) AS tf FROM d, (SELECT unnest(['crate', 'ramp']) AS term) q),
m AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM w WHERE tf > 0)"""


@query(
    "bm25_exact",
    with_(_BM25) + """SELECT doc_id AS description_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
FROM m, c GROUP BY 1 HAVING count(*) = 2""",
)
def bm25_exact(spark, folder):
    docs = Memory(spark, folder).table("scene_descriptions")
    found = lexical.search(docs, "description_id", "crate ramp", limit=None, stemmed=False)
    return found.select("description_id", F.round("score", 9).alias("score"))


@query("bm25_stored", ORACLE["bm25_exact"])
def bm25_stored(spark, folder):
    """The same search over a stored index that was filled in two goes, the second overlapping the first."""
    docs = Memory(spark, folder).table("scene_descriptions")
    index = lexical.Postings(spark, fresh_path(spark, "index"), 16, stemmed=False)
    index.append(docs.where(f"ts < {END}"), "description_id")
    index.append(docs, "description_id")
    found = lexical.search(docs, "description_id", "crate ramp", limit=None, stemmed=False, postings=index)
    return found.select("description_id", F.round("score", 9).alias("score"))


@query("bm25_porter")
def bm25_porter(spark, folder):
    """Stemmed search over observations with hard filters ahead of the cut."""
    mem = Memory(spark, folder)
    hard = Filters(since=START, until=END).hard()
    return lexical.search(mem.scan(), "observation_id", "carrying crates", hard)


@query("search_descriptions")
def search_descriptions(spark, folder):
    return lexical.search(Memory(spark, folder).table("scene_descriptions"), "description_id", "talking into a radio", limit=100)


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    return rows.select(F.lit("observation").alias("kind"), F.col("vec_id").cast("string").alias("ref_id"), F.lit("m").alias("model"), F.size("embedding").alias("dim"), F.col("embedding").alias("vec"))


def _probe(spark: SparkSession, folder: str) -> list[float]:
    return [float(x) for x in spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id = 0").first()["embedding"]]


_COS = "cs AS (SELECT CAST(a.vec_id AS VARCHAR) AS ref_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b)"


@query("cosine_topk_floor", with_(_COS) + "SELECT ref_id, round(score, 5) AS score FROM cs WHERE score >= 0.3 ORDER BY score DESC, ref_id LIMIT 200")
def cosine_topk_floor(spark, folder):
    return semantic.cosine_topk(_vectors(spark, folder), _probe(spark, folder)).select("ref_id", F.round("score", 5).alias("score"))


_LISTS = "a_ AS (SELECT observation_id, row_number() OVER (ORDER BY confidence DESC NULLS LAST, observation_id) AS r FROM o WHERE origin = 'rule' ORDER BY r LIMIT 500), b_ AS (SELECT observation_id, row_number() OVER (ORDER BY ts DESC NULLS LAST, observation_id) AS r FROM o WHERE origin = 'rule' ORDER BY r LIMIT 200)"
_FUSED = "fu AS (SELECT observation_id, coalesce(1 / (60.0 + a_.r), 0.0) + coalesce(1 / (60.0 + b_.r), 0.0) AS score, CASE WHEN b_.r IS NULL THEN 'lexical' WHEN a_.r IS NULL THEN 'semantic' ELSE 'both' END AS reason FROM a_ FULL JOIN b_ USING (observation_id))"


def _two_lists(mem: Memory) -> tuple[DataFrame, DataFrame]:
    rows = mem.scan(Filters(origins=["rule"]))
    one = rows.orderBy(F.desc("confidence"), "observation_id").limit(500)
    two = rows.orderBy(F.desc("ts"), "observation_id").limit(200)
    return ranking.ranked(one, score="confidence"), ranking.ranked(two, score="ts")


@query("rrf_fuse", with_(O, _LISTS, _FUSED) + "SELECT observation_id, round(score, 9) AS score, reason FROM fu")
def rrf_fuse(spark, folder):
    a, b = _two_lists(Memory(spark, folder))
    return ranking.fuse(lexical=a, semantic=b).withColumn("score", F.round("score", 9))


@query(
    "visual_rerank",
    with_(O, _LISTS, _FUSED) + """, hd AS (SELECT observation_id FROM fu ORDER BY score DESC, observation_id LIMIT 50),
v AS (SELECT observation_id, row_number() OVER (ORDER BY confidence DESC, observation_id) AS r FROM o JOIN hd USING (observation_id) WHERE confidence IS NOT NULL)
SELECT fu.observation_id, round(score + coalesce(0.5 / (60.0 + v.r), 0.0), 9) AS score, v.r IS NOT NULL AS reranked FROM fu LEFT JOIN v USING (observation_id)""",
)
def visual_rerank(spark, folder):
    mem = Memory(spark, folder)
    a, b = _two_lists(mem)
    seen = mem.scan(Filters(origins=["rule"])).where("confidence IS NOT NULL").select("observation_id", F.col("confidence").alias("similarity"))
    return ranking.rerank(ranking.fuse(lexical=a, semantic=b), seen).select("observation_id", F.round("score", 9).alias("score"), "reranked")


@query(
    "collapse_runs",
    with_(O) + f""", h AS (SELECT subject_entity_id AS entity_id, predicate, ts, confidence AS score, observation_id FROM o WHERE {window()} AND confidence IS NOT NULL AND subject_entity_id IS NOT NULL AND predicate IS NOT NULL),
n AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= 120 THEN 0 ELSE 1 END AS nw FROM h WINDOW w AS (PARTITION BY entity_id, predicate ORDER BY ts, observation_id)),
i AS (SELECT *, sum(nw) OVER (PARTITION BY entity_id, predicate ORDER BY ts, observation_id ROWS UNBOUNDED PRECEDING) AS isl FROM n)
SELECT entity_id, predicate, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n, max(score) AS score FROM i GROUP BY entity_id, predicate, isl""",
)
def collapse_runs(spark, folder):
    rows = Memory(spark, folder).scan(Filters(since=START, until=END)).where("confidence IS NOT NULL AND subject_entity_id IS NOT NULL AND predicate IS NOT NULL")
    hits = rows.select(F.col("subject_entity_id").alias("entity_id"), "predicate", "text", "ts", F.col("confidence").alias("score"), F.lit("lexical").alias("reason"), "observation_id")
    return ranking.collapse_hits(hits).select("entity_id", "predicate", "first_seen", "last_seen", "n", "score")


_ASKED = f"""d AS (SELECT observation_id AS doc_id, {_TOKENS} AS t FROM o),
c AS (SELECT count(*) AS n, sum(coalesce(len(t), 0)) / count(*) AS avgdl FROM d),
w AS (SELECT doc_id, len(t) AS dl, len(list_filter(t, lambda x: x = 'crate')) AS tf FROM d),
m AS (SELECT *, count(*) OVER () AS df FROM w WHERE tf > 0),
lx AS (SELECT doc_id AS observation_id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM m, c
  WHERE doc_id IN (SELECT observation_id FROM o WHERE {window()})),
a_ AS (SELECT observation_id, row_number() OVER (ORDER BY round(score, 9) DESC, observation_id) AS r FROM lx ORDER BY r LIMIT 500),
sm AS (SELECT observation_id, round(score, 6) AS score FROM cs JOIN o ON CAST(o.seq AS VARCHAR) = cs.ref_id WHERE score >= 0.3 AND {window()}),
b_ AS (SELECT observation_id, row_number() OVER (ORDER BY score DESC, observation_id) AS r FROM sm ORDER BY r LIMIT 200)"""


@query("ask_text", with_(O, _COS, _ASKED, _FUSED) + "SELECT observation_id, round(score, 9) AS score, reason FROM fu")
def ask_text(spark, folder):
    """A word question within a window: exact words, exact vectors (those of the embedding table, by seq), fused."""
    mem = Memory(spark, folder)
    ids = mem.scan().select(F.col("seq").cast("string").alias("ref_id"), "observation_id")
    vectors = _vectors(spark, folder).join(ids, "ref_id").drop("ref_id").withColumnRenamed("observation_id", "ref_id")
    index = retrieval.SearchIndex(embeddings=vectors, encoder=lambda texts: [_probe(spark, folder)], model="m", stemmed=False)
    found = retrieval.retrieve(mem, normalize_plan({"start": START, "end": END, "text": "crate"}), index)
    return found.select("observation_id", F.round("score", 9).alias("score"), "reason")


@query("text_backlog_anti", with_(O) + "SELECT observation_id, ts FROM o WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM embeddings x WHERE x.vec_id = o.seq) ORDER BY ts DESC NULLS LAST, observation_id DESC LIMIT 500")
def text_backlog_anti(spark, folder):
    mem = Memory(spark, folder)
    have = _vectors(spark, folder).withColumnRenamed("ref_id", "seq_").withColumn("ref_id", F.col("seq_"))
    rows = mem.scan().where("text IS NOT NULL").select(F.col("seq").cast("string").alias("key"), "observation_id", "ts")
    left = rows.join(have.select(F.col("ref_id").alias("key")), "key", "left_anti")
    return semantic.backlog(left, have.withColumn("ref_id", F.lit("-")), "observation", "m", "observation_id", 500).select("observation_id", "ts")


# --- identity and corrections ---------------------------------------------------


def _faces(mem: Memory) -> DataFrame:
    return identity.clean(mem.signatures("face"))


_SIG = """sg0 AS (SELECT * FROM signatures WHERE kind = 'face' AND len(vec) = dim AND NOT list_contains(vec, 'nan'::FLOAT) AND (list_max(vec) <> 0 OR list_min(vec) <> 0)
  AND len(list_filter(vec, lambda x: x IS NULL)) = 0 QUALIFY row_number() OVER (PARTITION BY sig_id ORDER BY created_at) = 1),
sg1 AS (SELECT s.*, sqrt(list_dot_product(CAST(vec AS DOUBLE[]), CAST(vec AS DOUBLE[]))) AS len_ FROM sg0 s JOIN e USING (entity_id) WHERE lower(trim(e.status)) = 'active'),
sg AS (SELECT sig_id, entity_id, list_transform(CAST(vec AS DOUBLE[]), lambda x: x / len_) AS v FROM sg1),
sp AS (SELECT a.entity_id AS a, b.entity_id AS b, max(list_dot_product(a.v, b.v)) AS sim FROM sg a JOIN sg b ON a.entity_id < b.entity_id GROUP BY 1, 2)"""


@query("merge_suggestions", with_(E, _SIG) + "SELECT a AS source_id, b AS target_id, round(sim, 3) AS similarity FROM sp WHERE sim >= 0.8")
def merge_suggestions(spark, folder):
    return identity.similar_entities(_faces(Memory(spark, folder)), 0.8).select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.round("similarity", 3).alias("similarity"))


@query("auto_merge_moves", with_(O, E, _SIG) + """, ed AS (SELECT a, b FROM sp WHERE sim >= 0.8 UNION SELECT b, a FROM sp WHERE sim >= 0.8),
rc AS (SELECT * FROM (WITH RECURSIVE q AS (SELECT a AS id, a AS root FROM ed UNION SELECT ed.a, q.root FROM q JOIN ed ON ed.b = q.id) SELECT id, min(root) AS root FROM q GROUP BY 1)),
rk AS (SELECT rc.id, root, row_number() OVER (PARTITION BY root ORDER BY coalesce(label <> '', false) DESC, coalesce(n, 0) DESC, id) AS k FROM rc LEFT JOIN e ON e.entity_id = rc.id
  LEFT JOIN (SELECT subject_entity_id, count(*) AS n FROM o GROUP BY 1) c ON c.subject_entity_id = rc.id)
SELECT x.id AS src, y.id AS dst FROM rk x JOIN rk y ON y.root = x.root AND y.k = 1 WHERE x.k > 1""")
def auto_merge_moves(spark, folder):
    mem = Memory(spark, folder)
    return corrections.merge_moves(identity.similar_entities(_faces(mem), 0.8).select("a", "b"), mem.entities, mem.scan())


@query(
    "best_match",
    with_(E, _SIG) + """, p AS (SELECT a.sig_id AS probe_id, b.entity_id, round(list_dot_product(a.v, b.v), 9) AS s FROM sg a JOIN sg b ON a.sig_id <> b.sig_id)
SELECT probe_id, entity_id, round(s, 3) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY s DESC, entity_id) = 1""",
)
def best_match(spark, folder):
    faces = _faces(Memory(spark, folder))
    probes = faces.select(F.col("sig_id").alias("probe_id"), "vec")
    return identity.best_matches(probes, faces).select("probe_id", "entity_id", F.round("similarity", 3).alias("similarity"))


@query("threshold_sweep")
def threshold_sweep(spark, folder):
    """On the label centres of the embedding table, in order of id."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    return identity.threshold_sweep(rows.select(F.col("vec_id").alias("seq"), F.col("embedding").alias("vec")))


@query("separation_matrix", "WITH m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS len_ FROM m GROUP BY 1) SELECT CAST(p.label AS VARCHAR) AS a, CAST(q.label AS VARCHAR) AS b, round(sum(p.x * q.x) / any_value(pn.len_) / any_value(qn.len_), 3) AS similarity FROM m p JOIN m q ON p.i = q.i AND CAST(p.label AS VARCHAR) < CAST(q.label AS VARCHAR) JOIN n pn ON pn.label = p.label JOIN n qn ON qn.label = q.label GROUP BY 1, 2")
def separation_matrix(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    found = identity.separation(rows.select(F.col("label").cast("string").alias("entity_id"), F.col("embedding").alias("vec")))
    return found.withColumn("similarity", F.round("similarity", 3))


def _moves(mem: Memory) -> DataFrame:
    return corrections.told_moves(mem.table("entities"))


@query("merge_repointed", with_(O, MOVES) + "SELECT observation_id, coalesce(a.dst, subject_entity_id) AS subject_entity_id, coalesce(b.dst, object_entity_id) AS object_entity_id FROM o LEFT JOIN mv a ON a.src = subject_entity_id LEFT JOIN mv b ON b.src = object_entity_id")
def merge_repointed(spark, folder):
    mem = Memory(spark, folder)
    return corrections.repoint(mem.scan().select("observation_id", "subject_entity_id", "object_entity_id"), ["subject_entity_id", "object_entity_id"], _moves(mem))


@query("merge_snapshots", with_(SNAPSHOTS, MOVES) + "SELECT snapshot_id, array_to_string(list_sort(list(DISTINCT coalesce(dst, x))), '|') AS present FROM (SELECT snapshot_id, unnest(present_entity_ids) AS x FROM sn) LEFT JOIN mv ON src = x GROUP BY 1")
def merge_snapshots(spark, folder):
    mem = Memory(spark, folder)
    return corrections.repoint_snapshots(mem.snapshots(), _moves(mem)).select("snapshot_id", F.array_join("present_entity_ids", "|").alias("present"))


_GONE = "scene:unknown"


@query("cascade_delete_counts", with_(O) + f"SELECT 'signatures' AS \"table\", (SELECT count(*) FROM signatures WHERE entity_id = '{_GONE}') AS n UNION ALL SELECT 'observations', count(*) FROM o WHERE subject_entity_id = '{_GONE}' OR object_entity_id = '{_GONE}'")
def cascade_delete_counts(spark, folder):
    mem = Memory(spark, folder)
    tables = {"observations": mem.scan(), "signatures": mem.table("signatures"), "entities": mem.entities}
    return corrections.cascade_delete(tables, _GONE)[1]


@query("signatures_newest", with_(E) + """, a AS (SELECT * FROM signatures QUALIFY row_number() OVER (PARTITION BY sig_id ORDER BY created_at) = 1)
SELECT sig_id, a.entity_id, kind FROM a JOIN e USING (entity_id) WHERE lower(trim(e.status)) = 'active' QUALIFY row_number() OVER (PARTITION BY a.entity_id, kind ORDER BY a.created_at DESC, sig_id DESC) <= 2""")
def signatures_newest(spark, folder):
    return Memory(spark, folder).newest_signatures(2).select("sig_id", "entity_id", "kind")


# --- reports, geometry and live operators ----------------------------------------


_FACTS = """j AS (SELECT d.*, CASE WHEN json_valid(raw) THEN from_json(raw, '{"people":[{"ref":"VARCHAR","state":"VARCHAR","context_analysis":"VARCHAR"}],"notable":["VARCHAR"],"objects":[{"label":"VARCHAR","description":"VARCHAR"}],"locations":[{"location":"VARCHAR","contents":["VARCHAR"]}]}') END AS r FROM scene_descriptions d),
fp AS (SELECT description_id, unnest(r.people) AS p, unnest(range(len(r.people))) AS k FROM j), fn AS (SELECT description_id, unnest(r.notable) AS n, unnest(range(len(r.notable))) AS k FROM j),
fo AS (SELECT description_id, unnest(r.objects) AS o, unnest(range(len(r.objects))) AS k FROM j), fl AS (SELECT description_id, unnest(r.locations) AS l, unnest(range(len(r.locations))) AS k FROM j),
fc AS (SELECT description_id, trim(coalesce(l.location, '')) AS place, trim(unnest(l.contents)) AS item, k, unnest(range(len(l.contents))) AS m FROM fl),
ot AS (SELECT description_id, k, trim(o.label) || CASE WHEN trim(o.description) <> '' THEN ' — ' || trim(o.description) ELSE '' END AS text FROM fo WHERE trim(o.label) <> ''),
f0 AS (SELECT description_id, 1 AS part, 2 * k AS k, 0 AS m, coalesce(nullif(p.ref, ''), 'person') AS ref, 'state:' || p.state AS predicate, p.state AS text, 'people' AS section, NULL AS place FROM fp WHERE p.state <> ''
  UNION ALL SELECT description_id, 1, 2 * k + 1, 0, coalesce(nullif(p.ref, ''), 'person'), 'context_analysis:' || p.context_analysis, p.context_analysis, 'people', NULL FROM fp WHERE p.context_analysis <> ''
  UNION ALL SELECT description_id, 2, k, 0, 'scene', n, n, 'notable', NULL FROM fn WHERE n <> ''
  UNION ALL SELECT description_id, 3, k, 0, 'scene', 'object:' || text, text, 'objects', NULL FROM ot
  UNION ALL SELECT description_id, 4, k, m, 'scene', 'area:' || CASE WHEN place <> '' THEN place || ' — ' || item ELSE item END, item || CASE WHEN place <> '' THEN ' in ' || place ELSE '' END, 'locations', nullif(place, '') FROM fc WHERE item <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY description_id ORDER BY part, k, m) - 1 AS i FROM f0 QUALIFY i < 64)"""


@query("report_facts", with_(_FACTS) + "SELECT description_id, CAST(i AS INT) AS i, ref, predicate, text, section, place FROM f")
def report_facts(spark, folder):
    return reports.report_facts(Memory(spark, folder).table("scene_descriptions"))


@query("report_flattened", "SELECT description_id, text FROM scene_descriptions WHERE text <> ''")
def report_flattened(spark, folder):
    return reports.flattened(Memory(spark, folder).table("scene_descriptions"))


@query(
    "report_observations",
    with_(_FACTS, "z AS (SELECT name AS place, min(location_id) AS zone FROM locations GROUP BY 1)") + f"""SELECT {stable('obs', 'f.description_id', 'CAST(i AS VARCHAR)')} AS observation_id,
  CASE WHEN section IN ('objects', 'locations') THEN 'scene:' || coalesce(zone, location_id, camera_id, 'unknown') ELSE ref END AS subject_entity_id, f.predicate,
  CASE WHEN section IN ('objects', 'locations') THEN coalesce(zone, location_id) ELSE location_id END AS location_id, ts, CAST(0.6 AS DOUBLE) AS confidence, source_ref, 'vlm' AS origin, camera_id, f.description_id, f.text
FROM f JOIN scene_descriptions d USING (description_id) LEFT JOIN z USING (place) WHERE section IN ('objects', 'locations') OR ref LIKE 'ent\\_%' ESCAPE '\\'""",
)
def report_observations(spark, folder):
    mem = Memory(spark, folder)
    return reports.report_observations(mem.table("scene_descriptions"), mem.locations)


@query("due_users", f"SELECT CAST(c_custkey AS VARCHAR) AS user_id, {T0 + 8 * 3600} - (CASE WHEN c_custkey % 3 = 0 THEN 86400 ELSE 43200 END) AS since FROM customer WHERE (c_custkey % 3 = 0 AND {T0 + 8 * 3600} - ({T0} - c_custkey % 24 * 3600) >= 43200) OR (c_custkey % 3 = 1 AND {T0 + 8 * 3600} - ({T0} - c_custkey % 24 * 3600) >= 21600)")
def due_users(spark, folder):
    """Delivery settings made of the customer table; it is 8 in the morning."""
    rows = spark.read.parquet(f"{folder}/customer.parquet")
    users = rows.select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.element_at(F.array(F.lit("daily"), F.lit("twice_daily"), F.lit("never")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("delivery_schedule"),
        (F.lit(T0) - F.col("c_custkey") % 24 * 3600).alias("last_delivered_at"),
    )
    return reports.due_users(users, T0 + 8 * 3600)


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Detections made of the order lines: several in a frame, with boxes, classes and zones."""
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    x, y = (F.col("l_partkey") * 7 % 1500).cast("int"), (F.col("l_suppkey") * 13 % 900).cast("int")
    w, h = (F.col("l_quantity") * 4 + 20).cast("int"), (F.col("l_quantity") * 8 + 30).cast("int")
    cam = F.element_at(F.array(*(F.lit(c) for c in ("cam_gantry", "cam_lintel", "cam_mast", "cam_alcove"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    return rows.select(
        cam.alias("camera_id"), F.col("l_orderkey").alias("frame_index"), (F.lit(T0) + F.col("l_orderkey")).cast("double").alias("ts"),
        F.concat(F.lit("ent_"), F.lpad((F.col("l_partkey") % 50).cast("string"), 6, "0")).alias("entity_id"),
        F.when(F.col("l_linenumber") % 2 == 1, "person").otherwise("forklift").alias("cls"),
        (F.lit(1.0) - F.col("l_discount")).alias("conf"), F.lit(None).cast("string").alias("source_ref"),
        F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2")).alias("bbox"), F.col("l_linenumber").alias("line"),
        (F.col("l_orderkey") % 7 < 3).cast("double").alias("motion_fraction"),
    )


_BOXES = f"""bx AS (SELECT ['cam_gantry','cam_lintel','cam_mast','cam_alcove'][l_orderkey % 4 + 1] AS camera_id, l_orderkey AS frame_index, {T0} + l_orderkey AS ts,
  'ent_' || lpad(CAST(l_partkey % 50 AS VARCHAR), 6, '0') AS entity_id, CASE WHEN l_linenumber % 2 = 1 THEN 'person' ELSE 'forklift' END AS cls, l_linenumber AS line,
  l_partkey * 7 % 1500 AS x1, l_suppkey * 13 % 900 AS y1, l_partkey * 7 % 1500 + CAST(floor(l_quantity * 4 + 20) AS INT) AS x2, l_suppkey * 13 % 900 + CAST(floor(l_quantity * 8 + 30) AS INT) AS y2 FROM lineitem)"""


@query(
    "near_pairs_iou",
    with_(_BOXES) + """, q AS (SELECT a.camera_id, a.frame_index, a.entity_id, b.entity_id AS object_entity_id,
  greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS ov,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS ar,
  sqrt(power((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + power((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)) / ((a.x2 - a.x1 + a.y2 - a.y1 + b.x2 - b.x1 + b.y2 - b.y1) / 4 + 1e-9) AS dist
  FROM bx a JOIN bx b ON a.camera_id = b.camera_id AND a.frame_index = b.frame_index AND a.cls = 'person' AND b.cls <> 'person')
SELECT camera_id, frame_index, entity_id, object_entity_id, round(CASE WHEN ov = 0 THEN 0.0 ELSE ov / (ar - ov + 1e-9) END, 6) AS overlap FROM q WHERE (CASE WHEN ov = 0 THEN 0.0 ELSE ov / (ar - ov + 1e-9) END) >= 0.02 OR dist <= 1.5""",
)
def near_pairs_iou(spark, folder):
    rows = _boxes(spark, folder).withColumn("location_id", F.lit(None).cast("string"))
    return pipeline.near_pairs(rows).select("camera_id", "frame_index", "entity_id", "object_entity_id", F.round("overlap", 6).alias("overlap"))


@query(
    "zone_assign",
    with_(_BOXES) + """, sg AS (SELECT location_id, camera_id, polygon AS p, unnest(range(1, len(polygon) + 1)) AS i FROM locations WHERE len(polygon) > 2 AND camera_id IS NOT NULL),
ed AS (SELECT location_id, camera_id, p[i].x AS xi, p[i].y AS yi, p[CASE WHEN i = 1 THEN len(p) ELSE i - 1 END].x AS xj, p[CASE WHEN i = 1 THEN len(p) ELSE i - 1 END].y AS yj FROM sg),
c AS (SELECT bx.frame_index, bx.line, bx.x1, bx.y1, bx.x2, bx.y2, ed.location_id, count(*) FILTER ((yi > y2) <> (yj > y2) AND (x1 + x2) / 2.0 < (xj - xi) * (y2 - yi) / (yj - yi + 1e-9) + xi) AS n FROM (SELECT DISTINCT * FROM bx) bx JOIN ed USING (camera_id) GROUP BY 1, 2, 3, 4, 5, 6, 7)
SELECT frame_index, line, x1, y1, x2, y2, min(location_id) AS location_id FROM c WHERE n % 2 = 1 GROUP BY 1, 2, 3, 4, 5, 6""",
)
def zone_assign(spark, folder):
    found = pipeline.in_zones(_boxes(spark, folder), Memory(spark, folder).locations)
    return found.where("location_id IS NOT NULL").select("frame_index", "line", "bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2", "location_id").distinct()


@query("presence_cooldown")
def presence_cooldown(spark, folder):
    """Ten-second cooldown of every subject's sightings, replayed."""
    rows = _boxes(spark, folder).withColumn("location_id", F.lit(None).cast("string"))
    return pipeline.observe(pipeline.sightings(rows)).select("subject_entity_id", "predicate", "object_entity_id", "ts")


@query("settle_frames", with_(_BOXES) + """, f AS (SELECT DISTINCT camera_id, frame_index, ts, frame_index % 7 < 3 AS moving FROM bx),
g AS (SELECT *, sum(CASE WHEN moving THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY camera_id, island ORDER BY ts) AS k FROM g WHERE NOT moving)
SELECT camera_id, frame_index, ts FROM r WHERE island > 0 AND k = 3""")
def settle_frames(spark, folder):
    frames = _boxes(spark, folder).select("camera_id", "frame_index", "ts", "motion_fraction").distinct()
    return pipeline.settled_frames(frames)


@query("rules_dwell_cooldown")
def rules_dwell_cooldown(spark, folder):
    """Two rules over the replayed detections: a dwell of a minute, and any person in a zone."""
    from memlake.sources.files import RULES, parse_rules

    rules = [
        {"name": "dwell", "trigger": {"class": "person"}, "gate": {"dwell_seconds": 4}},
        {"name": "ramp", "trigger": {"class": "person", "zone": "north_ramp"}, "cooldown": {"per_track_seconds": 60}},
    ]
    mem = Memory(spark, folder)
    armed = spark.createDataFrame(parse_rules({"rules": rules}), RULES)
    return pipeline.fire_rules(pipeline.in_zones(_boxes(spark, folder), mem.locations), armed, mem.locations).drop("observation_id")


@query("scene_inventories", with_(_BOXES) + f"SELECT 'any' AS location_id, CAST(floor(ts / 30) * 30 AS DOUBLE) AS ts, array_to_string(list_sort(list(DISTINCT entity_id)), '|') AS present FROM bx GROUP BY 1, 2")
def scene_inventories(spark, folder):
    found = pipeline.inventories(_boxes(spark, folder).withColumn("location_id", F.lit("any")))
    return found.select("location_id", "ts", F.array_join("present_entity_ids", "|").alias("present"))


@query("scene_triggers")
def scene_triggers(spark, folder):
    rows = _boxes(spark, folder).withColumn("location_id", F.lit(None).cast("string"))
    scenes = pipeline.scene_signatures(rows).withColumn("moving", F.col("frame_index") % 7 < 3).withColumn("settled", F.lit(False))
    return pipeline.triggers(scenes)


@query("motion_gate", with_(_BOXES) + "SELECT DISTINCT camera_id, frame_index FROM bx WHERE frame_index % 7 < 3 OR frame_index % 10 = 0")
def motion_gate(spark, folder):
    return pipeline.gate(_boxes(spark, folder)).select("camera_id", "frame_index").distinct()


@query("object_classes", "SELECT DISTINCT lower(trim(p_type)) AS name, lower(trim(p_type)) IN ('small plated steel', 'person') AS kept FROM part WHERE trim(p_type) <> ''")
def object_classes(spark, folder):
    return split_classes(spark.read.parquet(f"{folder}/part.parquet").select(F.col("p_type").alias("name")), ("small plated steel", "person"))


@query("latest_snapshot", with_(SNAPSHOTS) + "SELECT snapshot_id, ts, len(present_entity_ids) AS n FROM sn WHERE location_id = 'loc_1a15dbff0ebd' ORDER BY ts DESC LIMIT 1")
def latest_snapshot(spark, folder):
    return Memory(spark, folder).latest_snapshot("loc_1a15dbff0ebd").select("snapshot_id", "ts", F.size("present_entity_ids").cast("bigint").alias("n"))


@query("relation_scan", with_(O, E, HABITS, RELATIONS, _CANDIDATES) + f"SELECT kind, subject_entity_id, predicate, location_id FROM cand WHERE kind = 'habit' AND {_WEIGHT} >= 0.1")
def relation_scan(spark, folder):
    return _mined(Memory(spark, folder)).where("kind = 'habit' AND weight >= 0.1").select("kind", "subject_entity_id", "predicate", "location_id")


@query("single_subject_aggregate", with_(O) + "SELECT subject_entity_id, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM o WHERE subject_entity_id = 'scene:loc_1a15dbff0ebd' GROUP BY 1")
def single_subject_aggregate(spark, folder):
    rows = Memory(spark, folder).scan(Filters(subject="scene:loc_1a15dbff0ebd"))
    return rows.groupBy("subject_entity_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


# --- lookups and small operators ---------------------------------------------------


@query("point_lookup", with_(O) + "SELECT observation_id, seq, predicate FROM o WHERE observation_id IN (SELECT min(observation_id) FROM observations UNION ALL SELECT max(observation_id) FROM observations)")
def point_lookup(spark, folder):
    mem = Memory(spark, folder)
    ends = mem.observations.agg(F.min("observation_id"), F.max("observation_id")).first()
    return mem.scan(Filters(observation_ids=list(ends))).select("observation_id", "seq", "predicate")


@query("scene_subjects", "SELECT DISTINCT subject_entity_id FROM observations WHERE subject_entity_id LIKE 'scene:%'")
def scene_subjects(spark, folder):
    rows = Memory(spark, folder).observations
    return rows.where(F.col("subject_entity_id").startswith("scene:")).select("subject_entity_id").distinct()


@query("signatures_active", with_(E) + "SELECT DISTINCT sig_id, s.entity_id, kind FROM signatures s JOIN e USING (entity_id) WHERE lower(trim(e.status)) = 'active'")
def signatures_active(spark, folder):
    return Memory(spark, folder).signatures().select("sig_id", "entity_id", "kind")


@query("retained_keyframes", with_(O) + ", k AS (SELECT DISTINCT string_split(source_ref, '/')[-1] AS f FROM o WHERE seq % 3 = 0 AND source_ref IS NOT NULL) SELECT observation_id, source_ref FROM o WHERE string_split(source_ref, '/')[-1] IN (SELECT f FROM k)")
def retained_keyframes(spark, folder):
    rows = Memory(spark, folder).scan()
    kept = rows.where("seq % 3 = 0 AND source_ref IS NOT NULL").select(F.col("source_ref").alias("path"))
    return reports.retained(rows, kept).select("observation_id", "source_ref")


@query("expired_frames", with_(O) + f"SELECT DISTINCT source_ref AS path FROM o WHERE source_ref IS NOT NULL AND ts < {END - 7 * 86400}")
def expired_frames(spark, folder):
    rows = Memory(spark, folder).scan().where("source_ref IS NOT NULL")
    return reports.expired_frames(rows.select(F.col("source_ref").alias("path"), F.col("ts").alias("modified")), END).distinct()


@query("thread_titles", "SELECT doc_id, CASE WHEN length(t) <= 58 THEN t ELSE (CASE WHEN contains(left(t, 58), ' ') THEN regexp_replace(left(t, 58), '\\s\\S*$', '') ELSE left(t, 58) END) || '…' END AS title FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def thread_titles(spark, folder):
    from memlake.functions.columns import title_from_question

    return load(spark, folder, "documents").select("doc_id", title_from_question(F.col("text")).alias("title"))


@query(
    "case_items",
    with_(O, E) + """, it AS (SELECT 'entity' AS kind, entity_id AS ref_id FROM e UNION ALL SELECT 'alert', observation_id FROM o WHERE origin = 'rule' UNION ALL SELECT 'event', 'obs_gone')
SELECT kind, ref_id, coalesce(CASE WHEN kind = 'entity' THEN coalesce(nullif(e.label, ''), upper(e.type[1]) || lower(e.type[2:]) || ' ' || right(e.entity_id, 6)) END,
  replace(CASE WHEN origin = 'rule' AND predicate LIKE 'rule\\_fired:%' ESCAPE '\\' THEN predicate[12:] ELSE predicate END, '_', ' '), '(deleted)') AS label,
  coalesce(CASE WHEN kind = 'entity' THEN e.created_at END, o.ts) AS ts FROM it LEFT JOIN e ON e.entity_id = it.ref_id LEFT JOIN o ON o.observation_id = it.ref_id""",
)
def case_items(spark, folder):
    mem = Memory(spark, folder)
    items = mem.entities.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("ref_id")).unionByName(
        mem.scan(Filters(origins=["rule"])).select(F.lit("alert").alias("kind"), F.col("observation_id").alias("ref_id"))
    )
    return analytics.case_items(items.unionByName(spark.createDataFrame([("event", "obs_gone")], "kind string, ref_id string")), mem.entities, mem.scan())


@query("dismissed_fires", with_(O) + "SELECT observation_id, subject_entity_id AS entity_id, ts FROM o WHERE origin = 'rule' AND predicate = 'rule_fired:linger_at_ramp' AND source_ref IS NOT NULL AND seq % 5 = 0 ORDER BY ts DESC, observation_id LIMIT 3")
def dismissed_fires(spark, folder):
    """Every fifth fire counts as dismissed here."""
    rows = Memory(spark, folder).scan(Filters(origins=["rule"]))
    no = rows.where("seq % 5 = 0 AND predicate = 'rule_fired:linger_at_ramp'").withColumn(
        "predicate", F.concat(F.lit("digest:dismissed:rule:linger_at_ramp:"), "subject_entity_id", F.lit(":"), F.col("ts").cast("bigint").cast("string"))
    )
    no = no.withColumn("origin", F.lit("operator"))
    return digest.dismissed_fires(rows.unionByName(no), "linger_at_ramp").select("observation_id", "entity_id", "ts")


@query(
    "relation_by_key",
    with_(O, E, HABITS, RELATIONS, _CANDIDATES) + """, f AS (SELECT * FROM cand WHERE kind = 'relation' AND object_entity_id IS NULL)
SELECT kind, subject_entity_id, predicate, location_id FROM f ORDER BY subject_entity_id, location_id LIMIT 1""",
)
def relation_by_key(spark, folder):
    """The first edge to a place, found by its key, of which the object is null."""
    edges = _mined(Memory(spark, folder)).where("kind = 'relation' AND object_entity_id IS NULL")
    key = edges.select(*mining.KEY).orderBy("subject_entity_id", "location_id").first()
    return analytics.relation_by_key(edges, **(key.asDict() if key else dict.fromkeys(mining.KEY))).select("kind", "subject_entity_id", "predicate", "location_id")


@query(
    "coalesced_edges",
    with_(O, E, HABITS, RELATIONS, _CANDIDATES, MOVES) + f""", w AS (SELECT *, {_WEIGHT} AS weight, {_REL_ID} AS relation_id, len(evidence) AS n FROM cand)
SELECT kind, coalesce(a.dst, subject_entity_id) AS subject_entity_id, predicate, coalesce(b.dst, object_entity_id) AS object_entity_id, location_id, min(relation_id) AS relation_id,
  round(least(1.0, sum(weight)), 9) AS weight, CAST(sum(n) AS BIGINT) AS n_evidence, {NOW} AS last_reinforced_at, {NOW} AS created_at,
  arg_max(CASE WHEN weight >= 0.6 THEN 'confirmed' ELSE 'candidate' END, weight) AS status
FROM w LEFT JOIN mv a ON a.src = subject_entity_id LEFT JOIN mv b ON b.src = object_entity_id GROUP BY 1, 2, 3, 4, 5""",
)
def coalesced_edges(spark, folder):
    """The mined edges after all merges that the statuses tell, alike ones joined."""
    mem = Memory(spark, folder)
    moved = corrections.repoint(_mined(mem), ["subject_entity_id", "object_entity_id"], _moves(mem))
    return corrections.coalesce_edges(moved).drop("supporting_observation_ids").withColumn("weight", F.round("weight", 9))


@query("match_or_mint")
def match_or_mint(spark, folder):
    """All vectors of the embedding table as one batch of faces, the first of each label as the gallery."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vec"), F.min("vec_id").alias("created_at"))
    gallery = first.select(F.col("label").cast("string").alias("entity_id"), F.col("created_at").cast("string").alias("sig_id"), "vec", F.col("created_at").cast("double").alias("created_at"))
    return identity.match_or_mint(rows.select(F.col("vec_id").cast("string").alias("face_id"), F.col("vec_id").cast("double").alias("ts"), F.col("embedding").alias("vec")), gallery, 0.3)


@query("bound_tracks")
def bound_tracks(spark, folder):
    rows = _boxes(spark, folder).withColumn("track_id", (F.col("frame_index") % 40).cast("bigint"))
    return pipeline.bind_tracks(rows.withColumn("appearance", F.array((F.col("frame_index") % 5).cast("double"), F.lit(1.0))))
