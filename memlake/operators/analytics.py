"""Dashboards: counts, histograms, facets, timelines, map and graph, each a plain aggregation."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.columns import capitalised, frequency_band, keyframe_url, rule_name

# Fixed values.
ALERT_STATUSES = ("new", "acknowledged", "resolved", "dismissed")
SEVERITIES = ("low", "medium", "high", "critical")


def appearances(observations: DataFrame) -> DataFrame:
    """(entity_id, n, last_seen, keyframe): sightings of each subject and its newest picture."""
    at = F.struct("ts", "seq")
    return observations.groupBy(F.col("subject_entity_id").alias("entity_id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("ts").alias("last_seen"),
        F.max_by("source_ref", F.when(F.col("source_ref").isNotNull(), at)).alias("keyframe"),
    )


def entity_cards(entities: DataFrame, observations: DataFrame, now: float) -> DataFrame:
    """Active entities with how often, how recently and at what rate they are seen."""
    days = F.greatest((F.lit(now) - F.col("created_at")) / 86400.0, F.lit(1.0))
    seen = F.coalesce("n", F.lit(0))
    return (
        entities.join(appearances(observations), "entity_id", "left")
        .withColumn("times_seen", seen)
        .withColumn("frequency", frequency_band(seen, days))
        .select("entity_id", "type", "label", "times_seen", "last_seen", keyframe_url(F.col("keyframe")).alias("keyframe"), "frequency")
    )


def kpis(entities: DataFrame, observations: DataFrame) -> DataFrame:
    """One row: active persons and objects, and all observations."""
    active = F.lower(F.trim("status")) == "active"
    people = entities.agg(
        F.count_if(active & (F.col("type") == "person")).alias("total_persons"),
        F.count_if(active & (F.col("type") == "object")).alias("total_objects"),
    )
    total = observations.agg(F.count(F.lit(1)).alias("n")).scalar()
    return people.withColumn("total_observations", total)


def per_camera(observations: DataFrame) -> DataFrame:
    return observations.where("camera_id IS NOT NULL").groupBy("camera_id").agg(F.count(F.lit(1)).alias("n"))


def hourly(observations: DataFrame, since: float) -> DataFrame:
    """(hour, n): rows of each full hour of the epoch since a time."""
    hour = (F.floor(F.col("ts") / 3600) * 3600).cast("bigint")
    return observations.where(F.col("ts") >= since).groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def bin_index(ts: Column, since: float, until: float, bins: int) -> Column:
    span = max(until - since, 1.0)
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((ts - since) / span * bins))).cast("int")


def event_class(since: float) -> Column:
    """fired by a rule, unusual if the subject is new in the window, else routine."""
    return F.when(F.col("origin") == "rule", "fired").when(F.col("created_at") >= since, "unusual").otherwise("routine")


def classified(observations: DataFrame, entities: DataFrame, since: float, until: float, camera: str | None = None) -> DataFrame:
    rows = observations.where(F.col("ts").between(since, until))
    if camera:
        rows = rows.where(F.col("camera_id") == camera)
    who = entities.select(F.col("entity_id").alias("subject_entity_id"), "created_at", F.col("type").alias("entity_type"), F.col("label").alias("entity_label"))
    return rows.join(who, "subject_entity_id", "left").withColumn("class", event_class(since))


def _kept(want: str) -> Column:
    if want in ("", "all"):
        return F.lit(True)
    return F.col("class") == "fired" if want == "alerts" else F.col("entity_type") == want


def timeline(events: DataFrame, since: float, until: float, bins: int = 48, want: str = "") -> DataFrame:
    """(bin, fired, unusual, routine) of every bin, empty ones too."""
    bins = max(1, min(240, bins))
    spine = events.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    counted = events.where(_kept(want)).groupBy(bin_index(F.col("ts"), since, until, bins).alias("bin")).agg(
        *(F.count_if(F.col("class") == c).alias(c) for c in ("fired", "unusual", "routine"))
    )
    return spine.join(counted, "bin", "left").na.fill(0)


def timeline_chips(events: DataFrame) -> DataFrame:
    """One row: all events, alerts, and events by subject type, whatever is filtered."""
    return events.agg(
        F.count(F.lit(1)).alias("all"),
        F.count_if(F.col("class") == "fired").alias("alerts"),
        F.count_if(F.col("entity_type") == "person").alias("person"),
        F.count_if(F.col("entity_type") == "object").alias("object"),
    )


def alerts(observations: DataFrame, rules: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Rule rows with severity (medium unless the rule says otherwise) and status (new where null)."""
    rows = observations.where(F.col("origin") == "rule").select(
        F.col("observation_id").alias("id"),
        rule_name(F.col("predicate")).alias("rule"),
        F.coalesce("status", F.lit("new")).alias("status"),
        "assignee",
        F.col("camera_id").alias("camera"),
        "ts",
        "seq",
        F.col("subject_entity_id").alias("entity_id"),
        keyframe_url(F.col("source_ref")).alias("keyframe"),
    )
    if rules is None:
        rows = rows.withColumn("severity", F.lit("medium"))
    else:
        level = rules.select(F.col("name").alias("rule"), F.lower(F.coalesce("severity", F.lit("medium"))).alias("severity"))
        rows = rows.join(F.broadcast(level), "rule", "left")  # the rule file, read by the driver
        rows = rows.withColumn("severity", F.coalesce("severity", F.lit("medium")))
    if entities is not None:
        who = entities.select("entity_id", F.col("label").alias("_label"))
        rows = rows.join(who, "entity_id", "left").withColumn("entity", F.coalesce(F.nullif("_label", F.lit("")), "entity_id")).drop("_label")
    return rows


def facets(rows: DataFrame, dimensions: dict[str, tuple[str, ...]], wanted: dict[str, str | None], needle: str = "", text: Column | None = None) -> DataFrame:
    """(dimension, value, n) in one pass: each dimension is counted with its own filter lifted.

    ``all`` counts what passes every filter.
    """
    found = F.lower(text).contains(needle.lower()) if needle and text is not None else F.lit(True)

    def passes(lifted: str | None) -> Column:
        rules = [F.col(d) == v for d, v in wanted.items() if v and d != lifted]
        return reduce(and_, rules, found)

    cells = [("all", "all", passes(None))]
    cells += [(d, v, passes(d) & (F.col(d) == v)) for d, values in dimensions.items() for v in values]
    one = rows.agg(*(F.count_if(c).alias(f"c{i}") for i, (_, _, c) in enumerate(cells)))
    listed = F.array(
        *(F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("value"), F.col(f"c{i}").alias("n")) for i, (d, v, _) in enumerate(cells))
    )
    return one.select(F.explode(listed).alias("f")).select("f.*")


def chat_kpis(conversations: DataFrame, turns: DataFrame, user_id: str | None = None) -> DataFrame:
    """One row of sums over the stored turns; the mean latency is null where there is none."""
    owned = conversations if user_id is None else conversations.where(F.col("user_id") == user_id)
    rows = owned.select("conversation_id").join(turns, "conversation_id", "left")
    sums = [F.coalesce(F.sum(f"n_{c}"), F.lit(0)).alias(c) for c in ("entities", "observations", "keyframes", "rule_events")]
    mean = F.avg("latency_ms")
    return rows.agg(
        F.count_distinct("conversation_id").alias("threads"),
        F.count("turn_id").alias("questions"),
        *sums,
        F.when(mean != 0, F.bround(mean)).cast("bigint").alias("avg_latency_ms"),
        F.max("asked_at").alias("last_asked"),
    )


def conversation_list(conversations: DataFrame, turns: DataFrame, user_id: str | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    """Threads with their number of turns, the latest changed first, from ``offset`` on; without a user all are listed."""
    owned = conversations if user_id is None else conversations.where(F.col("user_id") == user_id)
    counted = turns.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_turns"), F.max("asked_at").alias("last_asked"))
    return (
        owned.join(counted, "conversation_id", "left")
        .withColumn("n_turns", F.coalesce("n_turns", F.lit(0)))
        .orderBy(F.desc("updated_at"), "conversation_id")
        .offset(offset)
        .limit(limit)
    )


def turns_of(turns: DataFrame, conversation_id: str) -> DataFrame:
    """A thread's turns in the order in which they were asked."""
    return turns.where(F.col("conversation_id") == conversation_id).orderBy("asked_at", "seq", "turn_id")


def answer_counts(rows: DataFrame) -> DataFrame:
    """One row of what an answer's rows hold: subjects, observations, pictures and rule events."""
    return rows.agg(
        F.count_distinct("subject_entity_id").alias("n_entities"),
        F.count(F.lit(1)).alias("n_observations"),
        F.count_distinct("source_ref").alias("n_keyframes"),
        F.count_if(F.col("predicate").startswith("rule_fired:")).alias("n_rule_events"),
    )


def case_list(cases: DataFrame, items: DataFrame, status: str | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    """Cases with the number of their items, in all and by kind, the latest changed first."""
    kinds = ("entity", "alert", "event")
    counted = items.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_items"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds))
    shown = cases if status is None else cases.where(F.col("status") == status)
    shown = shown.join(counted, "case_id", "left").fillna(0, ["n_items", *(f"n_{k}" for k in kinds)])
    return shown.orderBy(F.desc("updated_at"), "case_id").offset(offset).limit(limit)


def report_list(reports: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    """Stored reports without their bodies, the newest first."""
    return reports.drop("body").orderBy(F.desc("created_at"), "report_id").offset(offset).limit(limit)


def zone_centres(locations: DataFrame) -> DataFrame:
    """(location_id, zone_name, zone_camera, cx, cy): the mean of each polygon's corners."""
    n = F.size("polygon")

    def mean(axis: str) -> Column:
        total = F.aggregate(F.transform("polygon", lambda p: p[axis]), F.lit(0.0), lambda s, v: s + v)
        return F.when(n > 0, total / n).alias(f"c{axis}")

    return locations.select(
        "location_id",
        F.col("name").alias("zone_name"),
        F.col("camera_id").alias("zone_camera"),
        mean("x"),
        mean("y"),
    )


def map_markers(observations: DataFrame, entities: DataFrame, locations: DataFrame, since: float, rules: DataFrame | None = None) -> DataFrame:
    """Each subject where it was last seen, and every open alert; a zone's camera overrides the row's."""
    rows = observations.where(F.col("ts") >= since)
    at = F.struct("ts", "seq")
    last = rows.where("subject_entity_id IS NOT NULL").groupBy(F.col("subject_entity_id").alias("entity_id")).agg(
        F.max_by(F.struct("camera_id", "location_id", "ts"), at).alias("m")
    ).select("entity_id", "m.*")
    who = entities.select("entity_id", "label", "type")
    last = last.join(who, "entity_id", "left").select(
        F.coalesce("type", F.lit("object")).alias("kind"),
        F.col("entity_id").alias("id"),
        F.coalesce(F.nullif("label", F.lit("")), F.concat(capitalised(F.coalesce("type", F.lit("entity"))), F.lit(" "), F.expr("right(entity_id, 6)"))).alias("label"),
        "entity_id",
        "camera_id",
        "location_id",
        "ts",
    )
    open_ = rows.where((F.col("origin") == "rule") & (F.coalesce("status", F.lit("new")) != "resolved"))
    fired = open_.select(
        F.lit("alert").alias("kind"),
        F.col("observation_id").alias("id"),
        F.translate(rule_name(F.col("predicate")), "_", " ").alias("label"),
        F.col("subject_entity_id").alias("entity_id"),
        "camera_id",
        "location_id",
        "ts",
    )
    return (
        last.unionByName(fired)
        .join(F.broadcast(zone_centres(locations)), "location_id", "left")  # zones are drawn by hand: few
        .withColumn("camera_id", F.coalesce("zone_camera", "camera_id"))
        .drop("zone_camera")
    )


def graph_edges(relations: DataFrame) -> DataFrame:
    """Edges of the graph view: confirmed relations to things, habits to places."""
    sure = relations.where(F.col("status") == "confirmed")
    to = F.when(F.col("kind") == "relation", F.col("object_entity_id")).when(F.col("kind") == "habit", F.col("location_id"))
    return sure.withColumn("to", to).where(F.col("to").isNotNull()).select(
        F.concat_ws("|", "subject_entity_id", "predicate", "to").alias("id"),
        F.col("subject_entity_id").alias("from"),
        "to",
        F.col("predicate").alias("label"),
        (F.col("kind") == "habit").alias("dashes"),
        F.col("created_at").alias("t"),
    )


def graph_nodes(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Active entities, and the places that edges lead to."""
    own = entities.select("entity_id", "label", "type")
    own = own.select(
        F.col("entity_id").alias("id"),
        F.coalesce(F.nullif("label", F.lit("")), F.when(F.col("type") == "person", "Unknown Person").otherwise("Unknown Object")).alias("label"),
        F.when(F.col("type") == "person", "person").otherwise("object").alias("group"),
    )
    places = edges.where("dashes").select(F.col("to").alias("id")).distinct()
    return own.unionByName(places.select("id", F.col("id").alias("label"), F.lit("location").alias("group")))


def neighbours(relations: DataFrame, entities: DataFrame, entity_id: str) -> DataFrame:
    """One step around an entity, candidates too (dashed); suppressed edges and vanished things are left out."""
    own = relations.where((F.col("subject_entity_id") == entity_id) & (F.col("status") != "suppressed"))
    things = own.where("kind = 'relation' AND object_entity_id IS NOT NULL").join(
        entities.select(F.col("entity_id").alias("object_entity_id")), "object_entity_id", "left_semi"
    )
    places = own.where("kind = 'habit' AND location_id IS NOT NULL")
    return things.select(
        F.col("object_entity_id").alias("to"), "predicate", (F.col("status") != "confirmed").alias("dashes")
    ).unionByName(places.select(F.col("location_id").alias("to"), "predicate", F.lit(True).alias("dashes")))


def zones_by_camera(locations: DataFrame, cameras: DataFrame) -> DataFrame:
    """(camera_id, zones): zones of every camera, known or named by a zone; a null camera holds the unassigned ones."""
    listed = locations.groupBy("camera_id").agg(F.array_sort(F.collect_list("name")).alias("zones"))
    known = cameras.select(F.col("camera_id").alias("_known")).distinct()
    joined = listed.join(known, F.col("camera_id") == F.col("_known"), "full")
    return joined.select(F.coalesce("camera_id", "_known").alias("camera_id"), F.coalesce("zones", F.array().cast("array<string>")).alias("zones"))


def liveness(frames: DataFrame, now: float, seconds: float = 10.0) -> DataFrame:
    """(camera_id, last_frame_ts, up): a camera is up if its last frame is fresh."""
    last = frames.groupBy("camera_id").agg(F.max("ts").alias("last_frame_ts"))
    return last.withColumn("up", F.lit(now) - F.col("last_frame_ts") < seconds)


def inspect(entities: DataFrame, observations: DataFrame, signatures: DataFrame) -> DataFrame:
    """Each entity with its numbers of observations and of signatures by kind."""
    seen = observations.groupBy(F.col("subject_entity_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n_observations"))
    kinds = signatures.groupBy("entity_id").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("face", "body", "appearance"))
    )
    out = entities.select("entity_id", "type", "label", "status").join(seen, "entity_id", "left").join(kinds, "entity_id", "left")
    return out.na.fill(0, ["n_observations", "n_face", "n_body", "n_appearance"])


def inventory_asof(snapshots: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe_id, location_id, ts, present_entity_ids): the last inventory of the zone at or before each probe.

    Within each (zone, day) one sort over both tables carries the last inventory forward,
    so a busy zone is spread over its days; a day opens with the last inventory of the
    days before, found on the snapshots alone.  A probe before the first is empty.
    """
    day = F.floor(F.col("ts") / 86400)
    shots = snapshots.select("location_id", "ts", day.alias("day"), F.col("present_entity_ids").alias("present"))
    asked = probes.select("location_id", "ts", day.alias("day"), "probe_id")
    closing = shots.groupBy("location_id", "day").agg(F.max_by("present", "ts").alias("present"))
    w = Window.partitionBy("location_id").orderBy("day")
    until = F.coalesce(F.lead("day").over(w), asked.agg(F.max("day")).scalar(), F.col("day"))
    opening = (
        closing.withColumn("_until", until)
        .where(F.col("_until") > F.col("day"))
        .select("location_id", F.explode(F.sequence(F.col("day") + 1, F.col("_until"))).alias("day"), "present")
        .withColumn("ts", F.col("day") * 86400.0)
    )
    none = F.lit(None).cast("string").alias("probe_id")
    rows = (
        opening.select("location_id", "day", "ts", F.lit(0).alias("o"), none, "present")
        .unionByName(shots.select("location_id", "day", "ts", F.lit(1).alias("o"), none, "present"))
        .unionByName(
            asked.select("location_id", "day", "ts", F.lit(2).alias("o"), "probe_id", F.lit(None).cast("array<string>").alias("present"))
        )
    )
    within = Window.partitionBy("location_id", "day").orderBy("ts", "o").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("present", F.last("present", ignorenulls=True).over(within))
    return filled.where("o = 2").select(
        "probe_id", "location_id", "ts", F.coalesce("present", F.array().cast("array<string>")).alias("present_entity_ids")
    )


def evidence_near(observations: DataFrame, firsts: DataFrame, seconds: float = 10.0) -> DataFrame:
    """(entity_id, source_ref): the earliest picture within ``seconds`` of each subject's first sighting.

    The interval join runs on time slots of that length, three a probe.
    """
    shots = observations.where("source_ref IS NOT NULL AND ts IS NOT NULL").select("ts", "seq", "source_ref", F.floor(F.col("ts") / seconds).alias("slot"))
    asks = firsts.select("entity_id", F.col("ts").alias("first_ts"), F.explode(F.sequence(F.floor(F.col("ts") / seconds) - 1, F.floor(F.col("ts") / seconds) + 1)).alias("slot"))
    near = asks.join(shots, "slot").where(F.abs(F.col("ts") - F.col("first_ts")) <= seconds)
    return near.groupBy("entity_id").agg(F.min_by("source_ref", F.struct("ts", "seq")).alias("source_ref"))


def case_items(items: DataFrame, entities: DataFrame, observations: DataFrame) -> DataFrame:
    """(kind, ref_id, label, ts): what each attached id names; one that was deleted since still shows."""
    who = entities.select(
        F.col("entity_id").alias("ref_id"),
        F.coalesce(F.nullif("label", F.lit("")), F.concat(capitalised(F.col("type")), F.lit(" "), F.expr("right(entity_id, 6)"))).alias("_name"),
        F.col("created_at").alias("_born"),
    )
    said = F.translate(F.when(F.col("origin") == "rule", rule_name(F.col("predicate"))).otherwise(F.col("predicate")), "_", " ")
    what = observations.select(F.col("observation_id").alias("ref_id"), said.alias("_said"), F.col("ts").alias("_ts"))
    out = items.join(who, "ref_id", "left").join(what, "ref_id", "left")
    own = F.col("kind") == "entity"
    return out.select(
        "kind",
        "ref_id",
        F.coalesce(F.when(own, F.col("_name")), F.col("_said"), F.lit("(deleted)")).alias("label"),
        F.coalesce(F.when(own, F.col("_born")), F.col("_ts")).alias("ts"),
    )


def relation_by_key(relations: DataFrame, **key: str | None) -> DataFrame:
    """The edge with exactly this key; a part that is None matches a null."""
    return relations.where(reduce(and_, (F.col(k).eqNullSafe(F.lit(v)) for k, v in key.items()), F.lit(True)))
