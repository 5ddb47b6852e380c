"""Zone files, rule files and the camera configuration."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.columns import stable_id

RULES = (
    "name string, source string, trigger struct<class:string,zone:string,camera:string>, dwell_seconds double,"
    " verify_prompt string, cooldown_seconds double, enabled boolean, severity string"
)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Locations of a zone file: a JSON list, or an object with the list under ``zones``."""
    raw = spark.read.option("multiLine", "true").json(path)
    zones = raw.select(F.explode("zones").alias("z")).select("z.*") if "zones" in raw.columns else raw
    given = F.col("location_id") if "location_id" in zones.columns else F.lit(None).cast("string")
    camera = F.col("camera_id") if "camera_id" in zones.columns else F.lit(None).cast("string")
    return zones.select(
        F.coalesce(given, stable_id("loc", F.col("name"))).alias("location_id"),
        "name",
        F.transform("polygon", lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y"))).alias("polygon"),
        camera.alias("camera_id"),
    )


def parse_rules(data: dict | None) -> list[tuple]:
    """Rows of the rule table from a parsed rule file; what a rule leaves out has its default."""
    out = []
    for r in (data or {}).get("rules") or []:
        t = r.get("trigger") or {}
        out.append(
            (
                r["name"],
                r.get("source"),
                (t.get("class"), t.get("zone"), t.get("camera")),
                float((r.get("gate") or {}).get("dwell_seconds") or 0),
                (r.get("verify") or {}).get("prompt"),
                float((r.get("cooldown") or {}).get("per_track_seconds", 300) or 0),
                bool(r.get("enabled", True)),
                (r.get("severity") or "medium").lower(),
            )
        )
    return out


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rule file as a table; a missing file is an empty one.  A stream reads it anew each batch."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("rule files need PyYAML") from e
    file = Path(path)
    rows = parse_rules(yaml.safe_load(file.read_text()) if file.exists() else None)
    return spark.createDataFrame(rows, RULES)


def never_firing(rules: DataFrame, locations: DataFrame) -> DataFrame:
    """Rules whose zone doesn't exist, to be told rather than watched in silence."""
    zones = locations.select(F.col("name").alias("_z")).distinct()
    named = rules.where("enabled AND trigger.zone IS NOT NULL")
    return named.join(F.broadcast(zones), F.col("trigger.zone") == F.col("_z"), "left_anti").select("name", "trigger.zone")


def gate_rule(spec: dict, identity_enabled: bool = False) -> dict:
    """A compiled rule that is let through, or why it is refused.

    A rule that the camera can't observe is refused, and one about an individual unless
    identity was switched on.
    """
    if not spec.get("feasible"):
        return {"refused": "infeasible", "reason": spec.get("reason") or "the camera can't observe this"}
    if spec.get("targets_individual") and not identity_enabled:
        return {"refused": "needs_identity", "reason": spec.get("identity_note") or "it tracks an individual"}
    return {"rule": spec}


def resolve_cameras(cameras: Iterable[dict]) -> list[dict]:
    """Camera settings by name; two of one name are an error."""
    seen: dict[str, dict] = {}
    for c in cameras:
        if c["name"] in seen:
            raise ValueError(f"camera named twice: {c['name']}")
        seen[c["name"]] = dict(c)
    return list(seen.values())


def settings(defaults: dict, file: dict | None = None, environment: dict | None = None) -> dict:
    """Later sources win: defaults, then the file, then the environment; nulls don't override."""
    out = dict(defaults)
    for source in (file, environment):
        out.update({k: v for k, v in (source or {}).items() if v is not None})
    return out


def split_classes(names: DataFrame, known: Iterable[str]) -> DataFrame:
    """(name, kept): lower-cased and trimmed class names once each, and whether the detector knows them."""
    clean = names.select(F.lower(F.trim("name")).alias("name")).where("name != ''").distinct()
    return clean.withColumn("kept", F.col("name").isin(*known))
