"""A plan in, aggregated evidence out: one lazily built set of DataFrames per question."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.columns import (
    RULE,
    SCENE,
    hour_bucket,
    keyframe_url,
    local_day,
    local_weekday,
    rule_name,
)
from memlake.operators.mining import evidence_rows
from memlake.operators.ranking import collapse_hits, pick_spread
from memlake.plans.filters import Filters
from memlake.plans.query_plan import QueryPlan
from memlake.sources.memory import Memory

STATES_SHOWN, HITS_SHOWN, KEYFRAMES_SHOWN, HABITS_SHOWN, EDGE_IDS_SHOWN = 8, 6, 4, 6, 8
COLLAPSE_SECONDS = 120.0


@dataclass
class Answer:
    """What a question found; every frame is lazy."""

    plan: QueryPlan
    entities: DataFrame
    ranked: bool = False
    rule_events: DataFrame | None = None
    recurrence: DataFrame | None = None
    co_presence: DataFrame | None = None
    relations: DataFrame | None = None
    relaxation: dict = field(default_factory=dict)

    def total(self) -> DataFrame:
        """One row: observations behind the subjects that are shown."""
        return self.entities.agg(F.coalesce(F.sum("n_observations"), F.lit(0)).alias("total_observations"))

    def is_dead_end(self) -> bool:
        return all(f is None or f.isEmpty() for f in (self.entities, self.co_presence, self.relations))


def _accepted(plan: QueryPlan, named: bool = True) -> Column | None:
    """The subject rule on the label and type that are shown; None if any subject will do."""
    label, rules = F.lower("label"), []
    if named and plan.entity_type != "any":
        rules.append(F.col("type") == plan.entity_type)
    if named and plan.entity_labels:
        rules.append(reduce(or_, (label.contains(q.strip().lower()) for q in plan.entity_labels)))
    rules += [~label.contains(q.strip().lower()) for q in plan.exclude_entity_labels]
    return reduce(lambda a, b: a & b, rules) if rules else None


def restrict_subjects(mem: Memory, plan: QueryPlan, rows: DataFrame, column: str = "subject_entity_id") -> DataFrame:
    """Rows whose subject may answer.

    A positive rule keeps the subjects that satisfy it, an exclusion alone leaves out
    those that don't, so that neither lists more subjects than it must.
    """
    rule = _accepted(plan)
    if rule is None:
        return rows
    positive = bool(plan.entity_labels) or plan.entity_type != "any"
    ids = mem.subjects().where(rule if positive else ~rule).select(F.col("entity_id").alias(column))
    return rows.join(ids, column, "left_semi" if positive else "left_anti")


def matched_rows(mem: Memory, plan: QueryPlan, scores: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """The observations behind an answer, each once, with ``score`` and ``reason`` where a search ranked them."""
    filters = Filters(
        since=plan.start,
        until=plan.end,
        location_ids=mem.zone_ids(plan.zones),
        camera_ids=plan.cameras or None,
        exclude_predicates=plan.exclude_predicates or None,
        min_confidence=plan.min_confidence,
    )
    rows = mem.scan(filters)
    if only is not None:
        rows = rows.join(only.select(F.col("entity_id").alias("subject_entity_id")), "subject_entity_id", "left_semi")
    else:
        rows = restrict_subjects(mem, plan, rows)
    if plan.text or plan.predicate_contains:
        if scores is None:
            rows = rows.withColumns({"score": F.lit(None).cast("double"), "reason": F.lit(None).cast("string")})
        else:
            rows = rows.join(scores.select("observation_id", "score", "reason"), "observation_id", "left")
        wanted = F.col("score").isNotNull()
        if plan.predicate_contains and not plan.text:
            wanted = wanted | F.lower("predicate").contains(plan.predicate_contains)
        return rows.where(wanted)
    return rows.withColumns({"score": F.lit(None).cast("double"), "reason": F.lit(None).cast("string")})


def subject_totals(rows: DataFrame) -> DataFrame:
    """One row a subject: first and last seen, number of rows, best score and what found it."""
    return rows.groupBy(F.col("subject_entity_id").alias("entity_id")).agg(
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.count(F.lit(1)).alias("n_observations"),
        F.max("score").alias("match_score"),
        F.when(F.min("reason") == F.max("reason"), F.min("reason"))
        .when(F.min("reason").isNotNull(), "both")
        .alias("match_reason"),
    )


def _order(plan: QueryPlan, ranked: bool) -> list[Column]:
    if ranked:
        return [F.desc_nulls_last("match_score"), F.asc("first_seen"), F.asc("entity_id")]
    if plan.order == "desc":
        return [F.desc("last_seen"), F.asc("entity_id")]
    return [F.asc("first_seen"), F.asc("entity_id")]


def answer_entities(mem: Memory, plan: QueryPlan, rows: DataFrame, named: bool = True) -> DataFrame:
    """The subjects of an answer in its order, cut to its limit; aggregates stay complete."""
    ranked = bool(plan.text or plan.predicate_contains)
    shown = mem.labelled(subject_totals(rows))
    rule = _accepted(plan, named)
    if rule is not None:
        shown = shown.where(rule)
    shown = shown.withColumn("duration_s", F.bround(F.col("last_seen") - F.col("first_seen"), 1))
    shown = shown.orderBy(*_order(plan, ranked))
    return shown if plan.limit is None else shown.limit(plan.limit)


def states(rows: DataFrame, order: str = "asc", most: int = STATES_SHOWN) -> DataFrame:
    """(entity_id, states): the first different vision states of each subject in the asked order."""
    at = F.struct("ts", "seq")
    first = F.min(at) if order == "asc" else F.max(at)
    said = rows.where((F.col("origin") == "vlm") & ~F.col("predicate").startswith(RULE))
    once = said.groupBy(F.col("subject_entity_id").alias("entity_id"), "predicate").agg(first.alias("at"))
    sort = F.asc("at") if order == "asc" else F.desc("at")
    w = Window.partitionBy("entity_id").orderBy(sort, "predicate")
    top = once.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    listed = F.array_sort(F.collect_list(F.struct("k", "predicate")))
    return top.groupBy("entity_id").agg(F.transform(listed, lambda x: x["predicate"]).alias("states"))


def keyframes(rows: DataFrame, most: int = KEYFRAMES_SHOWN) -> DataFrame:
    """(entity_id, keyframes): pictures spread over the time that they cover, the ends kept."""
    frames = (
        rows.select(F.col("subject_entity_id").alias("entity_id"), "ts", keyframe_url(F.col("source_ref")).alias("url"))
        .where(F.col("url").isNotNull())
        .groupBy("entity_id", "url")
        .agg(F.min("ts").alias("ts"))
    )
    return pick_spread(frames, "entity_id", "url", most).withColumnRenamed("picked", "keyframes")


def hits(rows: DataFrame, most: int = HITS_SHOWN, window: float = COLLAPSE_SECONDS) -> DataFrame:
    """(entity_id, hits): ranked rows with near repeats collapsed, the best first."""
    scored = rows.where(F.col("score").isNotNull()).select(
        F.col("subject_entity_id").alias("entity_id"), "predicate", "text", "ts", "score", "reason", "observation_id"
    )
    runs = collapse_hits(scored, window)
    w = Window.partitionBy("entity_id").orderBy(F.desc("score"), "first_seen", "observation_id")
    top = runs.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    cols = ["k", "predicate", "text", "first_seen", "last_seen", "n", "score", "match_reason", "observation_id"]
    return top.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("hits"))


def rule_events(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("predicate").startswith(RULE)).select(
        F.col("subject_entity_id").alias("entity_id"),
        rule_name(F.col("predicate")).alias("rule"),
        "ts",
        keyframe_url(F.col("source_ref")).alias("keyframe"),
        "observation_id",
    )


def bucket(ts: Column, group_by: str) -> Column:
    return {"weekday": local_weekday, "hour": hour_bucket, "day": local_day}[group_by](ts)


def bucket_rank(name: Column, group_by: str) -> Column:
    """Orders equal counts: Monday first, else as the names run."""
    if group_by == "weekday":
        return F.array_position(F.array(*(F.lit(d) for d in ("mon", "tue", "wed", "thu", "fri", "sat", "sun"))), name)
    return name


def bucket_counts(rows: DataFrame, group_by: str) -> DataFrame:
    """(entity_id, bucket, n)."""
    return rows.groupBy(
        F.col("subject_entity_id").alias("entity_id"), bucket(F.col("ts"), group_by).alias("bucket")
    ).agg(F.count(F.lit(1)).alias("n"))


def recurrence(mem: Memory, plan: QueryPlan, rows: DataFrame, entities: DataFrame, habits: DataFrame | None = None) -> DataFrame:
    """How often and when each subject came: counts by bucket, distinct days, rate a week, top bucket and hour."""

    def top(counts: DataFrame, group_by: str, name: str) -> DataFrame:
        best = F.min_by(F.struct("bucket", "n"), F.struct(-F.col("n"), bucket_rank(F.col("bucket"), group_by).alias("o")))
        return counts.groupBy("entity_id").agg(best.alias(name))

    counts, hours = bucket_counts(rows, plan.group_by), bucket_counts(rows, "hour")
    days = rows.groupBy(F.col("subject_entity_id").alias("entity_id")).agg(
        F.count_distinct(local_day(F.col("ts"))).alias("n_occasions")
    )
    rank = F.struct((-F.col("n")).alias("c"), bucket_rank(F.col("bucket"), plan.group_by).alias("o"), "bucket", "n")
    groups = counts.groupBy("entity_id").agg(
        F.transform(F.array_sort(F.collect_list(rank)), lambda x: F.struct(x["bucket"].alias("bucket"), x["n"].alias("n"))).alias("groups")
    )
    span = F.greatest((F.col("last_seen") - F.col("first_seen")) / 86400.0, F.lit(0.0))
    out = (
        entities.select("entity_id", "label", "first_seen", "last_seen", F.col("n_observations").alias("n_sightings"))
        .join(days, "entity_id")
        .join(groups, "entity_id")
        .join(top(counts, plan.group_by, "top"), "entity_id")
        .join(top(hours, "hour", "top_hour"), "entity_id")
        .withColumn("span_days", F.bround(span, 2))
        .withColumn("per_week", F.bround(F.col("n_sightings") / F.greatest(span / 7.0, F.lit(1.0)), 2))
        .withColumn("group_by", F.lit(plan.group_by))
    )
    if habits is None:
        return out
    zones = mem.zone_ids(plan.zones)
    kept = habits if zones is None else habits.where(F.col("location_id").isin(zones) if zones else F.lit(False))
    w = Window.partitionBy("subject_entity_id").orderBy(F.desc("weight"), "predicate", "location_id")
    kept = kept.withColumn("k", F.row_number().over(w)).where(F.col("k") <= HABITS_SHOWN)
    listed = kept.groupBy(F.col("subject_entity_id").alias("entity_id")).agg(
        F.array_sort(
            F.collect_list(
                F.struct("k", "predicate", "location_id", F.bround("weight", 3).alias("weight"), "status")
            )
        ).alias("habits")
    )
    return out.join(listed, "entity_id", "left")


def present_pairs(snapshots: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, location_id, ts, entity_id, with_entity_id): anchors and who shared their frame.

    Pairs are made for the anchors only, the subjects a question names; without
    anchors each pair of a frame comes in both directions.
    """
    shared = snapshots.where(F.size("present_entity_ids") >= 2)
    ends = shared.select(
        "snapshot_id", "location_id", "ts", "present_entity_ids", F.explode("present_entity_ids").alias("entity_id")
    )
    if anchors is not None:
        ends = ends.join(anchors.select("entity_id"), "entity_id", "left_semi")
    return ends.select(
        "snapshot_id", "location_id", "ts", "entity_id", F.explode("present_entity_ids").alias("with_entity_id")
    ).where(F.col("entity_id") != F.col("with_entity_id"))


def co_presence(mem: Memory, plan: QueryPlan) -> DataFrame:
    """Who shared a frame with the subjects the question names, most shared frames first."""
    zones = mem.zone_ids(plan.zones)
    shots = mem.snapshots().where(Filters(since=plan.start, until=plan.end, location_ids=zones).hard())
    rule = _accepted(plan)
    anchors = mem.subjects().where(F.lit(True) if rule is None else rule)
    pairs = present_pairs(shots, anchors)
    together = pairs.groupBy(F.col("with_entity_id").alias("entity_id")).agg(
        F.array_sort(F.collect_set("entity_id")).alias("with_ids"),
        F.array_sort(F.collect_set("location_id")).alias("location_ids"),
        F.count_distinct("snapshot_id").alias("n_snapshots"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )
    return mem.labelled(together).orderBy(F.desc("n_snapshots"), "first_seen", "entity_id")


def edge_evidence(mem: Memory, plan: QueryPlan, relations: DataFrame) -> DataFrame:
    """Edges of the named subjects with each supporting row that passes the hard filters, and the far end."""
    edges = relations.where(F.col("kind").isin("relation", "event") & (F.coalesce("status", F.lit("")) != "suppressed"))
    edges = restrict_subjects(mem, plan, edges)
    far = F.coalesce(F.col("object_entity_id"), F.concat(F.lit(SCENE), F.col("location_id")))
    filters = Filters(
        since=plan.start, until=plan.end, location_ids=mem.zone_ids(plan.zones), camera_ids=plan.cameras or None,
        min_confidence=plan.min_confidence, exclude_predicates=plan.exclude_predicates or None,
    )
    rows = mem.scan(filters)
    shown = [
        "relation_id", "kind", "subject_entity_id", "predicate", "weight", "status",
        F.col("location_id").alias("edge_location"), far.alias("far_id"), "observation_id", "ts", "source_ref",
    ]
    mined = evidence_rows(rows, edges.where("supporting_observation_ids IS NULL OR size(supporting_observation_ids) = 0"), "ts", "source_ref")
    # edges that bring their evidence along: events, and those of other stores
    listed = edges.withColumn("observation_id", F.explode("supporting_observation_ids"))
    return mined.select(*shown).unionByName(listed.join(rows.select("observation_id", "ts", "source_ref"), "observation_id").select(*shown))


def relation_answer(mem: Memory, plan: QueryPlan, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with their evidence, entities at the far ends)."""
    evidence = edge_evidence(mem, plan, relations)
    by = ["relation_id", "kind", "subject_entity_id", "predicate", "weight", "status", "edge_location", "far_id"]
    w = Window.partitionBy("relation_id").orderBy("observation_id")
    top = evidence.select("relation_id", "observation_id").withColumn("k", F.row_number().over(w)).where(F.col("k") <= EDGE_IDS_SHOWN)
    shown = top.groupBy("relation_id").agg(F.array_sort(F.collect_list("observation_id")).alias("observation_ids"))
    edges = (
        evidence.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_supporting"))
        .join(shown, "relation_id")
        .withColumn("weight", F.bround("weight", 3))
    )
    ends = mem.labelled(edges.select(F.col("far_id").alias("entity_id")).distinct())
    edges = edges.join(ends.select(F.col("entity_id").alias("far_id"), F.col("label").alias("object_label")), "far_id")
    seen = evidence.groupBy(F.col("far_id").alias("entity_id")).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n_observations")
    )
    entities = mem.labelled(seen).withColumn("duration_s", F.bround(F.col("last_seen") - F.col("first_seen"), 1))
    entities = entities.orderBy(F.desc("n_observations"), "first_seen", "entity_id")
    return edges, entities if plan.limit is None else entities.limit(plan.limit)


def answer(
    mem: Memory, plan: QueryPlan, *, scores: DataFrame | None = None, relations: DataFrame | None = None, habits: DataFrame | None = None
) -> Answer:
    """Run one plan.  ``scores`` ranks observations (a word question), ``relations`` are the mined edges."""
    if plan.intent == "relations":
        if relations is None:
            raise ValueError("a question about relations needs the mined edges")
        edges, entities = relation_answer(mem, plan, relations)
        return Answer(plan, entities, relations=edges)
    companions = co_presence(mem, plan) if plan.intent == "who_with" else None
    if companions is not None:
        # the anchor's names and type don't apply to those found with it; exclusions do, on what is shown
        rows = matched_rows(mem, plan.but(entity_labels=(), entity_type="any", exclude_entity_labels=()), scores, companions)
        entities = answer_entities(mem, plan, rows, named=False)
    else:
        rows = matched_rows(mem, plan, scores)
        entities = answer_entities(mem, plan, rows)
    ranked = bool(plan.text or plan.predicate_contains)
    out = Answer(plan, entities, ranked, rule_events(rows), co_presence=companions)
    if plan.intent == "how_often":
        out.recurrence = recurrence(mem, plan, rows, entities, habits)
    return out


def with_details(mem: Memory, plan: QueryPlan, found: Answer, rows: DataFrame) -> DataFrame:
    """The subjects with their states, pictures and hits."""
    own = rows.join(found.entities.select(F.col("entity_id").alias("subject_entity_id")), "subject_entity_id", "left_semi")
    return (
        found.entities.join(states(own, plan.order), "entity_id", "left")
        .join(keyframes(own), "entity_id", "left")
        .join(hits(own), "entity_id", "left")
    )


def facts(entities: DataFrame) -> DataFrame:
    """The evidence as a narrator may see it: formatted times, no ids."""

    def shown(c: str) -> Column:
        return F.date_format(F.timestamp_seconds(F.col(c)), "E dd MMM HH:mm")

    return entities.select(
        "label",
        "type",
        shown("first_seen").alias("first_seen"),
        shown("last_seen").alias("last_seen"),
        "duration_s",
        "n_observations",
        F.col("match_reason").alias("matched_by"),
    )
