"""Distilling the log: habits, relations and change events as weighted, decaying edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.columns import (
    CONFIRM_AT,
    HALF_LIFE_DAYS,
    decayed,
    hour_bucket,
    increment,
    local_day,
    local_weekday,
    reinforced,
    stable_id,
)

MIN_DAYS, MIN_COUNT, WINDOW_DAYS, GONE_TAIL = 2, 3, 120, 3
KEY = ["kind", "subject_entity_id", "predicate", "object_entity_id", "location_id"]

# The detector's classes that are animals; all others are things.
ANIMALS = frozenset("bird cat dog horse sheep cow elephant bear zebra giraffe".split())
# Spellings of a predicate and the one they stand for.
CANONICAL = {
    "asleep": "sleeping", "napping": "sleeping", "eyes_closed": "sleeping", "on_phone": "using_phone",
    "on phone": "using_phone", "state:sleeping": "sleeping", "state:asleep": "sleeping",
}


def canonical(predicate: Column) -> Column:
    """The canonical spelling of a predicate, by the seeds."""
    pairs = [F.lit(x) for item in CANONICAL.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), predicate), predicate)


def canonicalised(rows: DataFrame, schema: DataFrame) -> DataFrame:
    """Rows with the predicate replaced by its canonical form, of the schema table first, then of the seeds."""
    known = (
        schema.where(F.col("canonical").isNotNull() & F.col("predicate").isNotNull())
        .groupBy("predicate")
        .agg(F.min("canonical").alias("_canonical"))
    )
    out = rows.join(F.broadcast(known), "predicate", "left")  # a hand-written vocabulary of fixed size
    return out.withColumn("predicate", F.coalesce("_canonical", canonical(F.col("predicate")))).drop("_canonical")


def legal_triples(rows: DataFrame, schema: DataFrame) -> DataFrame:
    """``rows`` (subject_type, predicate, object_type) with ``legal``: predicates that no rule names are free."""
    fits = ((F.col("s.subject_type") == "any") | (F.col("s.subject_type") == F.col("r.subject_type"))) & (
        (F.col("s.object_type") == "any") | F.col("s.object_type").eqNullSafe(F.col("r.object_type"))
    )
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    joined = keyed.alias("r").join(F.broadcast(schema).alias("s"), F.col("r.predicate") == F.col("s.predicate"), "left")
    legal = F.coalesce(F.bool_or(F.when(F.col("s.predicate").isNotNull(), F.coalesce(fits, F.lit(False)))), F.lit(True))
    return joined.groupBy("r._row", "r.subject_type", "r.predicate", "r.object_type").agg(legal.alias("legal")).drop("_row")


def mining_window(observations: DataFrame, days: float | None = WINDOW_DAYS) -> DataFrame:
    """The rows of the last ``days`` before the newest one: an outage doesn't empty the window."""
    if not days:
        return observations
    newest = observations.agg(F.max("ts")).scalar()
    return observations.where(F.col("ts") >= newest - days * 86400.0)


def _edge(kind: str, df: DataFrame, **cols) -> DataFrame:
    fixed = {"object_entity_id": F.lit(None).cast("string"), "location_id": F.lit(None).cast("string")} | cols
    return df.select(
        F.lit(kind).alias("kind"),
        F.col("subject_entity_id"),
        F.col("predicate"),
        *(c.alias(n) for n, c in fixed.items()),
        F.col("times"),
        F.col("confidence"),
        F.col("n_evidence") if "n_evidence" in df.columns else F.size("evidence").cast("bigint").alias("n_evidence"),
        F.col("evidence") if "evidence" in df.columns else F.lit(None).cast("array<string>").alias("evidence"),
    )


def habits(observations: DataFrame, min_days: int = MIN_DAYS) -> DataFrame:
    """Candidate habits: hours, and hours of a weekday, at which a subject is present in a zone on several days.

    Evidence is counted, not gathered: a hot subject's would be an array without bound.
    ``evidence_rows`` gives it as a table.
    """
    seen = observations.where("predicate = 'present' AND location_id IS NOT NULL AND subject_entity_id IS NOT NULL AND ts IS NOT NULL")
    hour, weekday = hour_bucket(F.col("ts")), local_weekday(F.col("ts"))
    names = F.array(F.concat(F.lit("present_around_"), hour), F.concat(F.lit("present_"), weekday, F.lit("_around_"), hour))
    found = (
        seen.select("subject_entity_id", "location_id", "observation_id", local_day(F.col("ts")).alias("day"), F.explode(names).alias("predicate"))
        # a day's rows first: the distinct count then sees one row a day
        .groupBy("subject_entity_id", "location_id", "predicate", "day")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("subject_entity_id", "location_id", "predicate")
        .agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("n_evidence"))
        .where(F.col("days") >= min_days)
        .withColumn("confidence", F.least(F.lit(1.0), F.col("days") / 5.0))
        .withColumn("times", F.lit(1).cast("bigint"))
    )
    return _edge("habit", found, location_id=F.col("location_id"))


def proximity_verb(label: Column) -> Column:
    """What repeated nearness to a thing means: an animal is company, everything else is used."""
    return F.when(F.lower(label).isin(*ANIMALS), "accompanied_by").otherwise("uses")


def relations(observations: DataFrame, entities: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Candidate relations: things that a subject is near, and zones that it frequents, often enough."""
    times, n_evidence = F.count(F.lit(1)).alias("times"), F.count(F.lit(1)).alias("n_evidence")
    near = (
        observations.where("predicate = 'near' AND object_entity_id IS NOT NULL AND subject_entity_id IS NOT NULL")
        .groupBy("subject_entity_id", "object_entity_id")
        .agg(times, n_evidence)
        .where(F.col("times") >= min_count)
        .join(entities.select(F.col("entity_id").alias("object_entity_id"), F.col("label").alias("_thing")), "object_entity_id", "left")
        .withColumn("predicate", proximity_verb(F.col("_thing")))
        .withColumn("confidence", F.lit(0.8))
    )
    often = (
        observations.where("predicate = 'present' AND location_id IS NOT NULL AND subject_entity_id IS NOT NULL")
        .groupBy("subject_entity_id", "location_id")
        .agg(times, n_evidence)
        .where(F.col("times") >= min_count)
        .withColumn("predicate", F.lit("frequents"))
        .withColumn("confidence", F.lit(0.7))
    )
    return _edge("relation", near, object_entity_id=F.col("object_entity_id")).unionByName(
        _edge("relation", often, location_id=F.col("location_id"))
    )


def evidence_rows(observations: DataFrame, edges: DataFrame, *carried: str) -> DataFrame:
    """(edge columns, observation_id, carried): the evidence of habits and relations as rows.

    ``edges`` needs the key columns; others come along, and so do the ``carried`` columns
    of the observations.  Nothing is gathered, however hot a subject is.  Evidence is
    what the log shows, so it isn't bound to a mining window.
    """
    hour, weekday = hour_bucket(F.col("ts")), local_weekday(F.col("ts"))
    taken = [F.col(c).alias(f"_c_{c}") for c in carried]
    zoned = observations.where("predicate = 'present' AND location_id IS NOT NULL AND subject_entity_id IS NOT NULL")
    names = F.array(
        F.struct(F.lit("habit").alias("kind"), F.concat(F.lit("present_around_"), hour).alias("predicate")),
        F.struct(F.lit("habit").alias("kind"), F.concat(F.lit("present_"), weekday, F.lit("_around_"), hour).alias("predicate")),
        F.struct(F.lit("relation").alias("kind"), F.lit("frequents").alias("predicate")),
    )
    at = ["kind", "predicate", "subject_entity_id", "location_id"]
    here = zoned.select("observation_id", "subject_entity_id", "location_id", *taken, F.explode(names).alias("p")).select(
        "p.*", "subject_entity_id", "location_id", "observation_id", *(f"_c_{c}" for c in carried)
    )
    places = edges.where("object_entity_id IS NULL AND kind IN ('habit', 'relation')")
    near = observations.where("predicate = 'near' AND object_entity_id IS NOT NULL AND subject_entity_id IS NOT NULL").select(
        "subject_entity_id", "object_entity_id", "observation_id", *taken
    )
    things = edges.where("kind = 'relation' AND predicate IN ('uses', 'accompanied_by') AND location_id IS NULL")
    order = [*edges.columns, "observation_id", *(F.col(f"_c_{c}").alias(c) for c in carried)]
    return here.join(places, at).select(*order).unionByName(near.join(things, ["subject_entity_id", "object_entity_id"]).select(*order))


def changes(snapshots: DataFrame, tail: int = GONE_TAIL) -> DataFrame:
    """(location_id, entity_id, kind, ts, evidence): who appeared in a zone after its first snapshot, and who is gone.

    Zones with a single snapshot show no change.  No task orders all snapshots of a
    zone: the last ones are found by day first, all else is an aggregation.
    """
    at = F.struct("ts", "seq", "snapshot_id")
    placed = snapshots.select("location_id", at.alias("at"), "present_entity_ids", F.floor(F.col("ts") / 86400).alias("day"))
    back = F.desc("at")
    last = placed.select("location_id", "day", "at").withColumn("k", F.row_number().over(Window.partitionBy("location_id", "day").orderBy(back)))
    last = last.where(F.col("k") <= tail).withColumn("k", F.row_number().over(Window.partitionBy("location_id").orderBy(back))).where(F.col("k") <= tail)
    tails = last.groupBy("location_id").agg(
        F.min("at").alias("tail"), F.transform(F.array_sort(F.collect_list("at")), lambda x: x["snapshot_id"]).alias("tail_ids")
    )
    ends = placed.groupBy("location_id").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count(F.lit(1)).alias("count"))
    ends = ends.where(F.col("count") >= 2).join(tails, "location_id")
    spans = (
        placed.select("location_id", "at", F.explode("present_entity_ids").alias("entity_id"))
        .groupBy("location_id", "entity_id")
        .agg(F.min("at").alias("first"), F.max("at").alias("last"))
        .join(F.broadcast(ends), "location_id")  # one row a zone
    )
    new = spans.where(F.col("first") > F.col("start")).select(
        "location_id", "entity_id", F.lit("new").alias("kind"), F.col("first.ts").alias("ts"), F.array("first.snapshot_id").alias("evidence")
    )
    gone = spans.where(F.col("last") < F.col("tail")).select(
        "location_id", "entity_id", F.lit("gone").alias("kind"), F.col("end.ts").alias("ts"), F.col("tail_ids").alias("evidence")
    )
    return new.unionByName(gone)


def change_events(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidate event edges: things are acquired or removed, persons appear.  Evidence holds snapshot ids."""
    verb = (
        F.when((F.col("type") == "object") & (F.col("change") == "new"), "acquired")
        .when((F.col("type") == "object") & (F.col("change") == "gone"), "removed")
        .when((F.col("type") == "person") & (F.col("change") == "new"), "appeared")
    )
    rows = (
        found.withColumnRenamed("kind", "change")
        .join(entities.select("entity_id", "type"), "entity_id")
        .withColumn("predicate", verb)
        .where(F.col("predicate").isNotNull())
        .withColumn("subject_entity_id", F.col("entity_id"))
        .withColumn("confidence", F.lit(0.5))
        .withColumn("times", F.lit(1).cast("bigint"))
    )
    return _edge("event", rows, location_id=F.col("location_id"))


def reinforce(current: DataFrame, candidates: DataFrame, now: float) -> DataFrame:
    """The edges after one pass: weights grow by the evidence, new edges appear, suppressed ones stay as they are.

    An edge is confirmed from ``CONFIRM_AT`` on; one that was confirmed isn't taken
    back here.  Keys compare null-safely.  The few snapshots behind a change are kept in
    the edge, as a sorted union; of habits and relations it holds how many observations
    the newest pass rested on.
    """
    added = candidates.groupBy(*KEY).agg(
        F.sum(increment(F.col("confidence"), F.col("times"))).alias("_added"),
        F.array_distinct(F.flatten(F.collect_list("evidence"))).alias("_evidence"),
        F.sum("n_evidence" if "n_evidence" in candidates.columns else F.size("evidence")).alias("_n"),
    )
    # a null-safe join as a plain equi-join: nulls get a value that no id has
    void = [F.coalesce(F.col(k), F.lit("\x00")).alias(f"_{k}") for k in KEY]
    left, right = current.select("*", *void), added.select("*", *void).drop(*KEY)
    both = left.join(right, [f"_{k}" for k in KEY], "full")
    grown = reinforced(F.col("weight"), F.col("_added"))
    frozen = (F.col("status") == "suppressed") | F.col("_added").isNull()
    evidence = F.array_sort(
        F.array_distinct(F.concat(F.coalesce("supporting_observation_ids", F.array().cast("array<string>")), F.coalesce("_evidence", F.array().cast("array<string>"))))
    )
    key = {k: F.when(F.col(f"_{k}") != "\x00", F.col(f"_{k}")) for k in KEY}
    return both.select(
        F.coalesce("relation_id", stable_id("rel", *(F.coalesce(c, F.lit("")) for c in key.values()))).alias("relation_id"),
        *(c.alias(k) for k, c in key.items()),
        F.when(frozen, F.col("weight")).otherwise(grown).alias("weight"),
        F.when(frozen, F.col("supporting_observation_ids")).otherwise(evidence).alias("supporting_observation_ids"),
        F.when(frozen, F.col("n_evidence")).otherwise(F.col("_n")).alias("n_evidence"),
        F.when(frozen, F.col("last_reinforced_at")).otherwise(F.lit(now)).alias("last_reinforced_at"),
        F.coalesce("created_at", F.lit(now)).alias("created_at"),
        F.when(frozen, F.col("status"))
        .when(grown >= CONFIRM_AT, "confirmed")
        .otherwise(F.coalesce("status", F.lit("candidate")))
        .alias("status"),
    )


def decay(current: DataFrame, now: float, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """The edges aged to ``now``; a confirmed edge that falls below the line becomes a candidate again."""
    weight = decayed(F.col("weight"), F.col("last_reinforced_at"), now, half_life_days)
    lost = (F.col("status") == "confirmed") & (weight < CONFIRM_AT) & (F.col("last_reinforced_at") < now)
    return current.withColumns({"status": F.when(lost, "candidate").otherwise(F.col("status")), "weight": weight})


def suppress(current: DataFrame, relation_id: str) -> DataFrame:
    """The edge is set to nothing for good: later passes skip it."""
    hit = F.col("relation_id") == relation_id
    return current.withColumns(
        {"weight": F.when(hit, 0.0).otherwise(F.col("weight")), "status": F.when(hit, "suppressed").otherwise(F.col("status"))}
    )


def distil(current: DataFrame, observations: DataFrame, entities: DataFrame, snapshots: DataFrame, now: float, days: float | None = WINDOW_DAYS) -> DataFrame:
    """One pass over the memory: age the edges, then add what the log and the snapshots show.

    ``observations`` are once each.  Passes aren't idempotent: evidence that is still in
    the window counts again, as a habit that goes on.
    """
    rows = mining_window(observations, days).withColumn("predicate", canonical(F.col("predicate")))
    found = habits(rows).unionByName(relations(rows, entities)).unionByName(change_events(changes(snapshots), entities))
    return reinforce(decay(current, now), found, now)


def empty_relations(spark) -> DataFrame:
    from memlake.schema import schema

    return spark.createDataFrame([], schema("relations"))
