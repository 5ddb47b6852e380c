"""The digest: what rules fired, what is unusual, and the routine rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions.columns import capitalised, keyframe_url, local_hour, rule_name
from memlake.operators.analytics import evidence_near

ITEM = ["signature", "band", "entity_id", "title", "ts", "location_id", "keyframe"]
BINS = 30


@dataclass
class Digest:
    """All parts are DataFrames; ``items`` holds both bands."""

    since: float
    now: float
    items: DataFrame
    routine: DataFrame
    histogram: DataFrame


def triaged(observations: DataFrame) -> DataFrame:
    """Signatures that an operator dismissed or confirmed before."""
    said = observations.where(F.col("predicate").rlike("^digest:(dismissed|confirmed):"))
    return said.select(F.regexp_extract("predicate", "^digest:[a-z]+:(.*)$", 1).alias("signature")).distinct()


def feedback(signature: str, entity_id: str, action: str, now: float, spark, user_id: str | None = None) -> DataFrame:
    """The observation that records a triage."""
    kinds = {"dismiss": "dismissed", "confirm": "confirmed"}
    if action not in kinds:
        raise ValueError(f"unknown digest action: {action}")
    return spark.createDataFrame(
        [(entity_id, f"digest:{kinds[action]}:{signature}", 1.0, "operator", float(now), user_id)],
        "subject_entity_id string, predicate string, confidence double, origin string, ts double, user_id string",
    )


def fired_items(rows: DataFrame) -> DataFrame:
    rule = rule_name(F.col("predicate"))
    return rows.where("origin = 'rule'").select(
        F.concat_ws(":", F.lit("rule"), rule, "subject_entity_id", F.col("ts").cast("bigint").cast("string")).alias("signature"),
        F.lit("rule_fired").alias("band"),
        F.col("subject_entity_id").alias("entity_id"),
        F.concat(F.lit("Rule fired: "), rule).alias("title"),
        "ts",
        "location_id",
        keyframe_url(F.col("source_ref")).alias("keyframe"),
    )


def first_seen_items(rows: DataFrame, observations: DataFrame, entities: DataFrame, since: float, now: float) -> DataFrame:
    """Entities that came into being in the window, with a picture of their own or one taken at the time."""
    new = entities.where(F.col("created_at").between(since, now)).select("entity_id", "created_at")
    own = observations.join(new.select(F.col("entity_id").alias("subject_entity_id")), "subject_entity_id", "left_semi")
    at = F.struct("ts", "seq")
    first = own.groupBy(F.col("subject_entity_id").alias("entity_id")).agg(
        F.min("ts").alias("ts"),
        F.min_by("location_id", at).alias("location_id"),
        F.min_by("source_ref", F.when(F.col("source_ref").isNotNull(), at)).alias("own"),
    )
    lacking = first.where("own IS NULL").select("entity_id", "ts")
    near = evidence_near(rows, lacking)
    return new.join(first.drop("ts"), "entity_id", "left").join(near, "entity_id", "left").select(
        F.concat(F.lit("first_seen:"), "entity_id").alias("signature"),
        F.lit("unusual").alias("band"),
        "entity_id",
        F.lit("First time seen").alias("title"),
        F.col("created_at").alias("ts"),
        "location_id",
        keyframe_url(F.coalesce("own", "source_ref")).alias("keyframe"),
    )


def habit_hours(relations: DataFrame) -> DataFrame:
    """(subject_entity_id, location_id, hours) of the hour habits; weekday habits say nothing about an hour."""
    hour = F.regexp_extract("predicate", r"^present_around_(\d+)h$", 1)
    rows = relations.where("kind = 'habit' AND location_id IS NOT NULL AND status != 'suppressed'").withColumn("h", hour)
    return rows.where("h != ''").groupBy("subject_entity_id", "location_id").agg(F.array_sort(F.collect_set(F.col("h").cast("int"))).alias("hours"))


def unusual_hours(rows: DataFrame, relations: DataFrame) -> DataFrame:
    """The first presence of a subject in a zone at an hour that none of its habits there covers.

    Habits cover an hour to either side, over midnight too; without habits nothing is unusual.
    """
    seen = rows.where("predicate = 'present' AND location_id IS NOT NULL").withColumn("h", local_hour(F.col("ts")))
    # the first row of each hour serves, so rows shrink on the map side, before the join
    first = F.min_by(F.struct("ts", "source_ref"), F.struct("ts", "seq"))
    seen = seen.groupBy("subject_entity_id", "location_id", "h").agg(first.alias("f")).select("*", "f.*").drop("f")
    covered = F.exists("hours", lambda x: (F.abs(F.col("h") - x) <= 1) | (F.abs(F.col("h") - x) >= 23))
    return seen.join(habit_hours(relations), ["subject_entity_id", "location_id"]).where(~covered)


def unusual_hour_items(rows: DataFrame, relations: DataFrame) -> DataFrame:
    found = unusual_hours(rows, relations)
    hours = F.concat(F.lit("["), F.array_join(F.transform("hours", lambda x: x.cast("string")), ", "), F.lit("]"))
    return found.select(
        F.format_string("unusual_hour:%s:%s:%02d", "subject_entity_id", "location_id", "h").alias("signature"),
        F.lit("unusual").alias("band"),
        F.col("subject_entity_id").alias("entity_id"),
        F.format_string("Present at unusual hour (%02dh local; habit hours: %s)", F.col("h"), hours).alias("title"),
        "ts",
        "location_id",
        keyframe_url(F.col("source_ref")).alias("keyframe"),
    )


def event_items(relations: DataFrame, since: float, now: float) -> DataFrame:
    mined = relations.where((F.col("kind") == "event") & F.col("created_at").between(since, now))
    return mined.select(
        F.concat(F.lit("event:"), "relation_id").alias("signature"),
        F.lit("unusual").alias("band"),
        F.col("subject_entity_id").alias("entity_id"),
        F.concat(capitalised(F.col("predicate")), F.lit(" ("), "status", F.lit(")")).alias("title"),
        F.col("created_at").alias("ts"),
        "location_id",
        F.lit(None).cast("string").alias("keyframe"),
    )


def build(observations: DataFrame, entities: DataFrame, active: DataFrame, locations: DataFrame, relations: DataFrame, since: float, now: float) -> Digest:
    """The report of a window; ``observations`` are once each."""
    rows = observations.where(F.col("ts").between(since, now))
    items = (
        fired_items(rows)
        .unionByName(first_seen_items(rows, observations, active, since, now))
        .unionByName(unusual_hour_items(rows, relations))
        .unionByName(event_items(relations, since, now))
        .join(triaged(observations), "signature", "left_anti")
    )
    named = items.join(entities.select("entity_id", "label", "type"), "entity_id", "left").join(
        F.broadcast(locations.select("location_id", F.col("name").alias("location"))), "location_id", "left"
    )
    label = F.coalesce(
        F.nullif("label", F.lit("")),
        F.concat(capitalised(F.coalesce("type", F.lit("entity"))), F.lit(" "), F.expr("right(entity_id, 6)")),
    )
    items = named.withColumn("label", label).drop("type", "location_id")
    routine = rows.agg(
        F.count_if(~F.col("origin").eqNullSafe("rule")).alias("observations"),
        F.count_distinct("subject_entity_id").alias("entities"),
    )
    return Digest(since, now, items.orderBy("band", F.desc("ts"), "signature"), routine, histogram(rows, items, since, now))


def histogram(rows: DataFrame, items: DataFrame, since: float, now: float, bins: int = BINS) -> DataFrame:
    """(bin, count, type) of all bins: f if a rule fired in it, else u if something was unusual, else r."""
    width = (now - since) / bins if now > since else 1.0

    def place(ts):
        return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((ts - since) / width))).cast("int")

    spine = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    counted = rows.groupBy(place(F.col("ts")).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    marks = items.groupBy(place(F.col("ts")).alias("bin")).agg(
        F.bool_or(F.col("band") == "rule_fired").alias("fired"), F.lit(True).alias("any")
    )
    return spine.join(counted, "bin", "left").join(marks, "bin", "left").select(
        "bin",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.when(F.col("fired"), "f").when(F.col("any"), "u").otherwise("r").alias("type"),
    )


def dismissed_fires(observations: DataFrame, rule: str, limit: int = 3) -> DataFrame:
    """(observation_id, entity_id, ts, source_ref): the newest fires of a rule that an operator dismissed.

    They are counter-examples for the rule's check, oldest first.
    """
    said = observations.where(F.col("predicate").startswith("digest:dismissed:rule:"))
    parts = F.split(F.expr(f"substring(predicate, {len('digest:dismissed:') + 1})"), ":")
    marks = said.where(F.size(parts) == 4).select(parts[1].alias("rule"), parts[2].alias("entity_id"), parts[3].alias("at")).distinct()
    fired = observations.where((F.col("origin") == "rule") & (F.col("predicate") == f"rule_fired:{rule}") & F.col("source_ref").isNotNull())
    fired = fired.select(
        "observation_id", F.col("subject_entity_id").alias("entity_id"), "ts", "source_ref", F.col("ts").cast("bigint").cast("string").alias("at")
    )
    linked = fired.join(marks.where(F.col("rule") == rule).select("entity_id", "at"), ["entity_id", "at"], "left_semi").drop("at")
    return linked.orderBy(F.desc("ts"), "observation_id").limit(limit).orderBy("ts", "observation_id")
