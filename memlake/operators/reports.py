"""Scene reports into facts, and digests into documents."""

from __future__ import annotations

import csv
import io
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.columns import html_escaped, scene_subject, stable_id

ROWS_AT_MOST = 64
REPORT = (
    "people array<struct<ref:string,state:string,context_analysis:string>>, notable array<string>,"
    " objects array<struct<label:string,description:string>>,"
    " locations array<struct<location:string,contents:array<string>>>"
)


def _fact(ref, predicate, text, section: str, place):
    return F.struct(
        ref.cast("string").alias("ref"), predicate.cast("string").alias("predicate"), text.cast("string").alias("text"),
        F.lit(section).alias("section"), place.cast("string").alias("place"),
    )


def report_facts(descriptions: DataFrame, most: int = ROWS_AT_MOST) -> DataFrame:
    """(description_id, i, ref, predicate, text, section, place): the facts of each report in its order.

    People first, then what is notable, objects, and the contents of places; at most
    ``most`` a report.  A report that isn't JSON has no facts.
    """
    r = F.from_json("raw", REPORT)
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<struct<ref:string,predicate:string,text:string,section:string,place:string>>")

    def some(c):
        return F.coalesce(c != "", F.lit(False))

    def person(p):
        ref = F.coalesce(F.nullif(p["ref"], F.lit("")), F.lit("person"))
        state = _fact(ref, F.concat(F.lit("state:"), p["state"]), p["state"], "people", none)
        context = _fact(ref, F.concat(F.lit("context_analysis:"), p["context_analysis"]), p["context_analysis"], "people", none)
        return F.concat(F.when(some(p["state"]), F.array(state)).otherwise(empty), F.when(some(p["context_analysis"]), F.array(context)).otherwise(empty))

    def thing(o):
        label, detail = F.trim(o["label"]), F.trim(o["description"])
        text = F.when(some(detail), F.concat_ws(" — ", label, detail)).otherwise(label)
        return _fact(F.lit("scene"), F.concat(F.lit("object:"), text), text, "objects", none)

    def content(place):
        def one(item):
            item = F.trim(item)
            named = some(place)
            return _fact(
                F.lit("scene"),
                F.concat(F.lit("area:"), F.when(named, F.concat_ws(" — ", place, item)).otherwise(item)),
                F.when(named, F.concat_ws(" in ", item, place)).otherwise(item),
                "locations",
                F.nullif(place, F.lit("")),
            )

        return one

    def area(a):
        return F.transform(F.filter(F.coalesce(a["contents"], F.array().cast("array<string>")), lambda i: some(F.trim(i))), content(F.trim(F.coalesce(a["location"], F.lit("")))))

    parts = [
        F.flatten(F.transform(F.col("r.people"), person)),
        F.transform(F.filter(F.col("r.notable"), some), lambda n: _fact(F.lit("scene"), n, n, "notable", none)),
        F.transform(F.filter(F.col("r.objects"), lambda o: some(F.trim(o["label"]))), thing),
        F.flatten(F.transform(F.col("r.locations"), area)),
    ]
    facts = F.slice(F.concat(*(F.coalesce(p, empty) for p in parts)), 1, most)
    return (
        descriptions.withColumn("r", r)
        .select("description_id", F.posexplode(facts).alias("i", "f"))
        .select("description_id", "i", "f.*")
    )


def flattened(descriptions: DataFrame) -> DataFrame:
    """(description_id, text): each report as one string."""
    listed = F.array_sort(F.collect_list(F.struct("i", "text")))
    return report_facts(descriptions).groupBy("description_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), " | ").alias("text"))


def report_observations(descriptions: DataFrame, locations: DataFrame, owners: DataFrame | None = None, confidence: float = 0.6) -> DataFrame:
    """The observations that reports give.

    Objects and places speak about the place, never about whoever was in the picture; a
    bare ``person`` or ``scene`` stands for the report's owner (``owners``:
    description_id, owner_entity_id), and a fact about nobody known is left out.
    """
    facts = report_facts(descriptions).join(
        descriptions.select("description_id", "camera_id", "location_id", "ts", "source_ref"), "description_id"
    )
    zones = locations.groupBy(F.col("name").alias("place")).agg(F.min("location_id").alias("_zone"))
    facts = facts.join(F.broadcast(zones), "place", "left")
    if owners is None:
        facts = facts.withColumn("owner_entity_id", F.lit(None).cast("string"))
    else:
        facts = facts.join(owners, "description_id", "left")
    free = F.col("section").isin("objects", "locations")
    zone = F.when(free, F.coalesce("_zone", "location_id")).otherwise(F.col("location_id"))
    subject = F.when(free, scene_subject(zone, F.col("camera_id"))).otherwise(
        F.when(F.col("ref").isin("person", "scene"), F.col("owner_entity_id")).otherwise(F.col("ref"))
    )
    out = facts.withColumn("location_id", zone).withColumn("subject_entity_id", subject)
    return out.where(free | F.col("subject_entity_id").startswith("ent_")).select(
        stable_id("obs", F.col("description_id"), F.col("i").cast("string")).alias("observation_id"),
        "subject_entity_id", "predicate", "location_id", "ts", F.lit(confidence).alias("confidence"), "source_ref",
        F.lit("vlm").alias("origin"), "camera_id", "description_id", "text",
    )


def due_users(users: DataFrame, now: float) -> DataFrame:
    """(user_id, since): whose digest is due: daily at 8 if the last is 12 hours old, twice a day at 8 and 20 if 6."""
    hour = F.hour(F.timestamp_seconds(F.lit(now)))
    age = F.lit(now) - F.coalesce("last_delivered_at", F.lit(0.0))
    daily = (F.col("delivery_schedule") == "daily") & (hour == 8) & (age >= 12 * 3600)
    twice = (F.col("delivery_schedule") == "twice_daily") & hour.isin(8, 20) & (age >= 6 * 3600)
    return users.where(daily | twice).select("user_id", (F.lit(now) - F.when(daily, 86400).otherwise(43200)).alias("since"))


def expired_frames(frames: DataFrame, now: float, days: float = 7.0) -> DataFrame:
    """Picture files (path, modified) past the retention; claims outlive their pictures."""
    return frames.where(F.col("modified") < now - days * 86400.0).select("path")


def retained(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Rows whose picture is still kept."""
    name = F.element_at(F.split("source_ref", "/"), -1)
    kept = frames.select(F.element_at(F.split("path", "/"), -1).alias("_f")).distinct()
    return rows.join(kept, name == F.col("_f"), "left_semi")


def _when(ts: float) -> str:
    return datetime.fromtimestamp(ts, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def render_csv(digest) -> str:
    """A digest as CSV with the sections SUMMARY, ACTIVITY and FINDINGS; findings are streamed row by row."""
    out = io.StringIO()
    w = csv.writer(out)
    bins = digest.histogram.orderBy("bin").collect()
    routine = digest.routine.first()
    bands = {r["band"]: r["n"] for r in digest.items.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    w.writerow(["SUMMARY"])
    w.writerow(["metric", "value"])
    rows = [
        ("period_start", _when(digest.since)), ("period_end", _when(digest.now)), ("generated", _when(digest.now)),
        ("total_observations", sum(b["count"] for b in bins)), ("entities_seen", routine["entities"]),
        ("rules_fired", bands.get("rule_fired", 0)), ("unusual_events", bands.get("unusual", 0)),
    ]
    w.writerows(rows)
    w.writerow([])
    w.writerow(["ACTIVITY"])
    w.writerow(["bucket_start", "observations", "band"])
    step = (digest.now - digest.since) / max(1, len(bins))
    band = {"r": "routine", "f": "rule_fired", "u": "unusual"}
    w.writerows((_when(digest.since + b["bin"] * step), b["count"], band[b["type"]]) for b in bins)
    w.writerow([])
    w.writerow(["FINDINGS"])
    w.writerow(["band", "title", "entity", "entity_id", "when", "location", "keyframe"])
    for i in digest.items.orderBy("band", F.desc("ts"), "signature").toLocalIterator():
        w.writerow([i["band"], i["title"], i["label"], i["entity_id"], _when(i["ts"]), i["location"] or "", (i["keyframe"] or "").rpartition("/")[2]])
    return out.getvalue()


def bar_heights(histogram: DataFrame, pixels: int = 52) -> DataFrame:
    """(bin, height): bars on a square-root scale, so that small counts show beside a peak."""
    peak = Window.partitionBy()
    top = F.greatest(F.max("count").over(peak), F.lit(1))
    return histogram.select("bin", "type", F.bround(F.sqrt(F.col("count") / top) * pixels).cast("int").alias("height"))


def render_html(digest, title: str = "Digest") -> str:
    """A digest as one HTML page; texts are escaped in the plan."""
    bars = "".join(
        f'<i class="{b["type"]}" style="height:{b["height"]}px"></i>' for b in bar_heights(digest.histogram).orderBy("bin").collect()
    )
    shown = digest.items.select("band", *(html_escaped(F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "label", "location")), "ts", "signature")
    rows = "".join(
        f"<tr><td>{i['band']}</td><td>{i['title']}</td><td>{i['label']}</td><td>{i['location']}</td><td>{_when(i['ts'])}</td></tr>"
        for i in shown.orderBy("band", F.desc("ts"), "signature").toLocalIterator()
    )
    routine = digest.routine.first()
    return (
        f"<html><head><title>{title}</title></head><body><h1>{title}</h1><p>{_when(digest.since)} to {_when(digest.now)}:"
        f" {routine['observations']} routine observations of {routine['entities']} subjects</p><div>{bars}</div>"
        f"<table>{rows}</table></body></html>"
    )


def render_text(digest) -> str:
    """A digest as plain lines."""
    routine = digest.routine.first()
    lines = [f"{_when(digest.since)} to {_when(digest.now)}"]
    for i in digest.items.orderBy("band", F.desc("ts"), "signature").toLocalIterator():
        lines.append(f"[{i['band']}] {_when(i['ts'])} {i['label']}: {i['title']}" + (f" @ {i['location']}" if i["location"] else ""))
    return "\n".join([*lines, f"routine: {routine['observations']} observations, {routine['entities']} subjects"])
