"""Detections to observations: the live operators, over a stream or a replayed table.

Every stateful operator is keyed (subject, rule and subject, or camera), so state is
spread over the cluster and a checkpoint carries it over restarts.  The same functions
run on a batch table, where each key's rows are taken in time order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memlake.functions.columns import centre_distance, contains_point, iou, stable_id
from memlake.streaming import steps

NEAR_IOU, NEAR_DISTANCE, MOTION_MIN, HEARTBEAT = 0.02, 1.5, 0.002, 10
LATENESS = "30 seconds"
#: A key's state is dropped when event time is so far past its last row; longer than any cooldown or dwell time.
STATE_IDLE_SECONDS = 7 * 86400
#: Rows of a keyed stream that are later than this are left out.
STATE_LATENESS = "1 day"


def keyed(df: DataFrame, keys: list[str], columns: str, step: Callable[[dict, dict], dict | None], order: str = "ts") -> DataFrame:
    """Fold ``step`` over each key's rows; rows for which it gives a dict are emitted.

    On a stream the state lives in the state store, until event time is
    ``STATE_IDLE_SECONDS`` past the key's last row.  On a table it starts empty, and one pass over rows sorted by
    key and time holds one key's state at a time.
    """
    names = [c.split()[0] for c in columns.split(", ")]

    def rows(state: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        out = [e for r in pdf.sort_values(order, kind="stable").to_dict("records") if (e := step(state, r)) is not None]
        return pd.DataFrame(out, columns=names)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, {}
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                key = tuple(r[k] for k in keys)
                if key != current:
                    current, state = key, {}
                if (e := step(state, r)) is not None:
                    out.append(e)
            yield pd.DataFrame(out, columns=names)

    if not df.isStreaming:
        return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(replay, columns)

    def live(key, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        state = json.loads(group.get[0]) if group.exists else {}
        pdf = pd.concat(list(batches))
        out = rows(state, pdf)
        group.update((json.dumps(state),))
        group.setTimeoutTimestamp(int((pdf["ts"].max() + 86400 + STATE_IDLE_SECONDS) * 1000))
        yield out

    # a day ahead, as a watermark starts at the epoch and drops what isn't after it
    timed = df.withColumn("_event", F.timestamp_seconds(F.col("ts") + 86400)).withWatermark("_event", STATE_LATENESS)
    return timed.groupBy(*keys).applyInPandasWithState(live, columns, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def gate(frames: DataFrame) -> DataFrame:
    """Frames worth looking at: motion, a scene just settled, or every tenth as a heartbeat."""
    settled = F.coalesce(F.col("settled"), F.lit(False)) if "settled" in frames.columns else F.lit(False)
    return frames.where((F.col("motion_fraction") >= MOTION_MIN) | settled | (F.col("frame_index") % HEARTBEAT == 0))


def settled_frames(frames: DataFrame) -> DataFrame:
    """(camera_id, frame_index, ts): the frames at which a camera's picture comes to rest.

    On a table: the frame that makes the stillness long enough, counted from the last
    motion.
    """
    if not frames.isStreaming:
        w = Window.partitionBy("camera_id").orderBy("ts", "frame_index")
        moving = F.coalesce(F.col("motion_fraction") >= MOTION_MIN, F.lit(False))
        placed = frames.withColumn("_still", ~moving).withColumn("_island", F.count_if(~F.col("_still")).over(w))
        k = F.count_if("_still").over(Window.partitionBy("camera_id", "_island").orderBy("ts", "frame_index"))
        placed = placed.where("_island > 0").withColumn("_k", k).where(F.col("_still") & (F.col("_k") == steps.SETTLE_FRAMES))
        return placed.select("camera_id", F.col("frame_index").cast("bigint").alias("frame_index"), F.col("ts").cast("double").alias("ts"))

    def step(state: dict, r: dict) -> dict | None:
        if steps.settle(state, bool(r["motion_fraction"] >= MOTION_MIN)):
            return {"camera_id": r["camera_id"], "frame_index": int(r["frame_index"]), "ts": float(r["ts"])}
        return None

    return keyed(frames, ["camera_id"], "camera_id string, frame_index bigint, ts double", step)


def in_zones(detections: DataFrame, locations: DataFrame) -> DataFrame:
    """Detections with ``location_id``: the first zone of their camera that holds the middle of their foot line.

    Zones are few and drawn by hand; they travel as one array a camera.
    """
    zones = locations.where(F.size("polygon") > 2).groupBy("camera_id").agg(
        F.array_sort(F.collect_list(F.struct("location_id", "polygon"))).alias("_zones")
    )
    z = zones.withColumnRenamed("camera_id", "_cam")
    x, y = (F.col("bbox.x1") + F.col("bbox.x2")) / 2.0, F.col("bbox.y2").cast("double")
    hit = F.filter("_zones", lambda s: contains_point(s["polygon"], x, y))
    joined = detections.join(F.broadcast(z), F.col("camera_id") == F.col("_cam"), "left")
    return joined.withColumn("location_id", F.try_element_at(hit, F.lit(1))["location_id"]).drop("_zones", "_cam")


def near_pairs(detections: DataFrame) -> DataFrame:
    """Persons and other things close to each other in one frame: overlapping, or within one and a half sizes.

    A frame holds a handful of detections, so pairs are made within (camera, frame).
    """
    cols = ["camera_id", "frame_index", "ts", "source_ref", "location_id", "entity_id", "bbox", "cls"]
    people = detections.where("cls = 'person'").select(*cols)
    things = detections.where("cls != 'person'").select(
        "camera_id", "frame_index", F.col("entity_id").alias("object_entity_id"), F.col("bbox").alias("other")
    )
    both = people.join(things, ["camera_id", "frame_index"])
    both = both.withColumn("overlap", iou(F.col("bbox"), F.col("other")))
    close = (F.col("overlap") >= NEAR_IOU) | (centre_distance(F.col("bbox"), F.col("other")) <= NEAR_DISTANCE)
    return both.where(close).withColumn("confidence", F.least(F.lit(0.9), F.lit(0.4) + F.col("overlap")))


SIGHTING = (
    "subject_entity_id string, predicate string, object_entity_id string, location_id string, ts double,"
    " confidence double, source_ref string, camera_id string"
)


def sightings(detections: DataFrame) -> DataFrame:
    """What each frame shows, before the cooldown: presence of all, nearness of persons and things."""
    none = F.lit(None).cast("string")
    here = detections.select(
        F.col("entity_id").alias("subject_entity_id"), F.lit("present").alias("predicate"), none.alias("object_entity_id"),
        "location_id", "ts", F.least(F.lit(0.99), F.col("conf")).alias("confidence"), "source_ref", "camera_id",
    )
    near = near_pairs(detections).select(
        F.col("entity_id").alias("subject_entity_id"), F.lit("near").alias("predicate"), "object_entity_id",
        "location_id", "ts", "confidence", "source_ref", "camera_id",
    )
    return here.unionByName(near)


def observe(rows: DataFrame, cooldown: float = steps.PRESENCE_COOLDOWN) -> DataFrame:
    """Sightings that are written: one of each (subject, predicate, object) in a cooldown, whatever the camera."""

    def clean(v):
        return None if isinstance(v, float) and pd.isna(v) else v

    def step(state: dict, r: dict) -> dict | None:
        if not steps.presence(state, float(r["ts"]), cooldown):
            return None
        return {c.split()[0]: clean(r[c.split()[0]]) for c in SIGHTING.split(", ")}

    key = rows.withColumn("_object", F.coalesce("object_entity_id", F.lit("")))
    found = keyed(key, ["subject_entity_id", "predicate", "_object"], SIGHTING, step)
    return found.withColumn("origin", F.lit("detector")).withColumn(
        "observation_id",
        stable_id("obs", F.col("subject_entity_id"), F.col("predicate"), F.coalesce("object_entity_id", F.lit("")), F.col("ts").cast("string")),
    )


FIRED = "rule string, subject_entity_id string, location_id string, camera_id string, ts double"


def fire_rules(detections: DataFrame, rules: DataFrame, locations: DataFrame, verifier: Callable[[str, str], str] | None = None) -> DataFrame:
    """Rule events: class, camera and zone fit, the dwell time is over, the cooldown too, and the check says yes.

    Rules are a small file and travel to all tasks; detections meet the rules of their
    class and camera, and each (rule, subject) has its own clocks.
    """
    zones = locations.groupBy(F.col("name").alias("_zname")).agg(F.min("location_id").alias("_zid"))
    armed = rules.where("enabled").select(
        F.col("name").alias("rule"), F.col("trigger.class").alias("_cls"), F.col("trigger.zone").alias("_zone"),
        F.col("trigger.camera").alias("_rcam"), "dwell_seconds", "cooldown_seconds", "verify_prompt",
    )
    armed = armed.join(zones, F.col("_zone") == F.col("_zname"), "left")
    fits = (F.col("_cls").isNull() | (F.col("cls") == F.col("_cls"))) & (F.col("_rcam").isNull() | (F.col("camera_id") == F.col("_rcam")))
    rows = detections.join(F.broadcast(armed), fits).select(
        "rule", F.col("entity_id").alias("subject_entity_id"), "location_id", "camera_id", "ts", "dwell_seconds",
        "cooldown_seconds", "verify_prompt",
        (F.col("_zone").isNull() | F.coalesce(F.col("location_id") == F.col("_zid"), F.lit(False))).alias("in_zone"),
    )

    def step(state: dict, r: dict) -> dict | None:
        prompt = r["verify_prompt"]
        ask = None
        if isinstance(prompt, str) and prompt:
            ask = (lambda: verifier(prompt, r["subject_entity_id"])) if verifier else (lambda: "unclear")
        if not steps.rule(state, float(r["ts"]), True, bool(r["in_zone"]), float(r["dwell_seconds"]), float(r["cooldown_seconds"]), ask):
            return None
        return {"rule": r["rule"], "subject_entity_id": r["subject_entity_id"], "location_id": r["location_id"], "camera_id": r["camera_id"], "ts": float(r["ts"])}

    found = keyed(rows, ["rule", "subject_entity_id"], FIRED, step)
    return found.select(
        stable_id("obs", F.col("rule"), F.col("subject_entity_id"), F.col("ts").cast("string")).alias("observation_id"),
        "subject_entity_id", F.concat(F.lit("rule_fired:"), "rule").alias("predicate"), "location_id", "camera_id", "ts",
        F.lit(0.9).alias("confidence"), F.lit("rule").alias("origin"), F.lit("new").alias("status"),
    )


def inventories(detections: DataFrame, seconds: int = 30) -> DataFrame:
    """(location_id, ts, present_entity_ids): who was in each zone in each stretch of time."""
    rows = detections.where("location_id IS NOT NULL")
    rows = rows.withColumn("event_time", F.timestamp_seconds("ts"))
    if rows.isStreaming:
        rows = rows.withWatermark("event_time", LATENESS)
    found = rows.groupBy(F.window("event_time", f"{seconds} seconds").alias("w"), "location_id").agg(
        F.array_sort(F.collect_set("entity_id")).alias("present_entity_ids")
    )
    return found.select("location_id", F.col("w.start").cast("double").alias("ts"), "present_entity_ids")


def scene_signatures(detections: DataFrame) -> DataFrame:
    """(camera_id, frame_index, ts, signature): the sorted bag of class and zone in each frame."""
    what = F.concat_ws(":", "cls", F.coalesce("location_id", F.lit("-")))
    return detections.groupBy("camera_id", "frame_index", "ts").agg(F.array_join(F.array_sort(F.collect_list(what)), "|").alias("signature"))


def triggers(scenes: DataFrame, lazy: bool = True) -> DataFrame:
    """(camera_id, ts, signature): scenes to be described.  ``scenes`` also has ``moving`` and ``settled``."""

    def step(state: dict, r: dict) -> dict | None:
        changed = state.get("signature") != r["signature"]
        state["signature"] = r["signature"]
        if steps.trigger(state, float(r["ts"]), changed, r["signature"], bool(r["moving"]), bool(r["settled"]), lazy):
            return {"camera_id": r["camera_id"], "ts": float(r["ts"]), "signature": r["signature"]}
        return None

    return keyed(scenes, ["camera_id"], "camera_id string, ts double, signature string", step)


def bind_tracks(detections: DataFrame, match: float = 0.6) -> DataFrame:
    """Detections with ``entity_id``: a known track keeps its entity; else a thing that looks alike is the same one; else a new one.

    What moves by itself is never matched by its looks.  Keyed by camera and class.
    """
    animate = {"person", "bird", "cat", "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe",
               "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat"}

    def step(state: dict, r: dict) -> dict | None:
        tracks, looks = state.setdefault("tracks", {}), state.setdefault("looks", {})
        track, look = str(int(r["track_id"])), [float(x) for x in (r["appearance"] if r["appearance"] is not None else [])]
        found = tracks.get(track)
        if found is None and look and r["cls"] not in animate:
            size = sum(x * x for x in look) ** 0.5 or 1.0
            best, sim = None, match
            for e, v in looks.items():
                s = sum(a * b for a, b in zip(look, v)) / (size * (sum(x * x for x in v) ** 0.5 or 1.0))
                if s >= sim:
                    best, sim = e, s
            found = best
        if found is None:
            found = f"ent_{r['camera_id']}_{r['cls']}_{track}"
            if look:
                looks[found] = look
        tracks[track] = found
        return {"camera_id": r["camera_id"], "frame_index": int(r["frame_index"]), "ts": float(r["ts"]), "track_id": int(r["track_id"]), "cls": r["cls"], "entity_id": found}

    return keyed(
        detections, ["camera_id", "cls"],
        "camera_id string, frame_index bigint, ts double, track_id bigint, cls string, entity_id string", step,
    )


def append_to(store, table: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: known keys are skipped, so that a batch run twice adds nothing."""

    def write(batch: DataFrame, _epoch: int) -> None:
        store.attach(table, batch)

    return write
