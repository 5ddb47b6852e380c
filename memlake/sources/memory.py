"""The memory: the tables of one folder, cleaned of repeats, and those derived from them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.columns import SCENE, display_label, place_of, stable_id
from memlake.plans.filters import Filters, scan
from memlake.sources.tables import load


class Memory:
    """Readers over a folder of canonical tables.

    ``observations`` is the raw log (redelivered rows included): ``scan`` and the
    operators count each once.  ``entities`` has one row an id, the newest.
    """

    def __init__(self, spark: SparkSession, folder: str, **tables: DataFrame):
        self.spark, self.folder, self._given = spark, folder, tables

    def table(self, name: str) -> DataFrame:
        return self._given[name] if name in self._given else load(self.spark, self.folder, name)

    @cached_property
    def observations(self) -> DataFrame:
        return self.table("observations")

    def scan(self, filters: Filters | None = None, order: str | None = None, limit: int | None = None) -> DataFrame:
        return scan(self.observations, filters or Filters(), order, limit)

    @cached_property
    def entities(self) -> DataFrame:
        """One row an id: the one of latest ``created_at``, then of greatest status."""
        rows = self.table("entities").where(F.col("entity_id").isNotNull())
        newest = F.max_by(F.struct("type", "label", "created_at", "status"), F.struct("created_at", "status", "label"))
        return rows.groupBy("entity_id").agg(newest.alias("e")).select("entity_id", "e.*")

    @cached_property
    def active(self) -> DataFrame:
        return self.entities.where(F.lower(F.trim("status")) == "active")

    @cached_property
    def locations(self) -> DataFrame:
        return self.table("locations")

    @cached_property
    def zone_names(self) -> DataFrame:
        """(place, place_name), for labels; a fixed, small table."""
        return self.locations.select(F.col("location_id").alias("place"), F.col("name").alias("place_name"))

    def zone_ids(self, names) -> list[str] | None:
        """Ids of the zones so named (any case); None for no names, empty when none is known.

        Zones are drawn by hand in a camera's picture, so the table is small.
        """
        if not names:
            return None
        wanted = [n.strip().lower() for n in names if n.strip()]
        found = self.locations.where(F.lower("name").isin(wanted)).select("location_id").distinct()
        return sorted(r[0] for r in found.collect())

    def labelled(self, subjects: DataFrame, column: str = "entity_id") -> DataFrame:
        """``subjects`` with ``label`` and ``type`` of the id in ``column``; those that can't be named drop out.

        The entity table isn't broadcast by hint: it grows with the data.
        """
        own = self.entities.select(F.col("entity_id").alias("_eid"), F.col("label").alias("_label"), F.col("type").alias("_type"))
        out = (
            subjects.withColumn("_place", place_of(F.col(column)))
            .join(own, F.col(column) == F.col("_eid"), "left")
            .join(F.broadcast(self.zone_names), F.col("_place") == F.col("place"), "left")
        )
        if column != "entity_id":
            out = out.withColumn("_keep", F.col("entity_id") if "entity_id" in subjects.columns else F.lit(None))
            out = out.withColumn("entity_id", F.col(column))
        out = out.withColumn("label", display_label(F.col("entity_id"), F.col("_label"), F.col("_type"), F.col("place_name")))
        out = out.withColumn("type", F.coalesce("_type", F.when(F.col("entity_id").startswith(SCENE), "scene")))
        out = out.where(F.col("label").isNotNull())
        if column != "entity_id":
            out = out.drop("entity_id")
            if "entity_id" in subjects.columns:
                out = out.withColumnRenamed("_keep", "entity_id")
        return out.drop("_place", "_eid", "_label", "_type", "place", "place_name", "_keep")

    def subjects(self) -> DataFrame:
        """Every subject that can be named: (entity_id, label, type), merged and deleted ones too."""
        scenes = (
            self.observations.where(F.col("subject_entity_id").startswith(SCENE))
            .select(F.col("subject_entity_id").alias("entity_id"))
            .distinct()
        )
        return self.labelled(self.entities.select("entity_id").unionByName(scenes))

    def snapshots(self, seconds: int = 1800) -> DataFrame:
        """Zone inventories: those stored, else who was seen in each zone in each stretch of time."""
        if "scene_snapshots" in self._given:
            return self._given["scene_snapshots"]
        rows = self.observations.where(
            "location_id IS NOT NULL AND ts IS NOT NULL AND subject_entity_id LIKE 'ent\\_%'"
        )
        slot = (F.floor(F.col("ts") / seconds) * seconds).cast("double")
        seen = rows.select("location_id", slot.alias("ts"), "subject_entity_id").distinct()
        return (
            seen.groupBy("location_id", "ts")
            .agg(F.array_sort(F.collect_list("subject_entity_id")).alias("present_entity_ids"))
            .select(
                stable_id("snap", F.col("location_id"), F.col("ts").cast("bigint").cast("string")).alias("snapshot_id"),
                F.col("ts").cast("bigint").alias("seq"),
                "location_id",
                "ts",
                "present_entity_ids",
            )
        )

    def latest_snapshot(self, location_id: str) -> DataFrame:
        return self.snapshots().where(F.col("location_id") == location_id).orderBy(F.desc("ts"), F.desc("seq")).limit(1)

    def cameras(self) -> DataFrame:
        """The cameras that appear in observations or own a zone, sorted."""
        seen = self.observations.select("camera_id").unionByName(self.locations.select("camera_id"))
        return seen.where("camera_id IS NOT NULL").distinct().orderBy("camera_id")

    def signatures(self, kind: str | None = None) -> DataFrame:
        """Signatures of active entities, each once."""
        rows = self.table("signatures")
        rows = rows if kind is None else rows.where(F.col("kind") == kind)
        return rows.dropDuplicates(["sig_id"]).join(self.active.select("entity_id"), "entity_id", "left_semi")

    def newest_signatures(self, keep: int = 12) -> DataFrame:
        """The newest signatures of each entity and kind."""
        w = Window.partitionBy("entity_id", "kind").orderBy(F.desc("created_at"), F.desc("sig_id"))
        return self.signatures().withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= keep).drop("_k")
