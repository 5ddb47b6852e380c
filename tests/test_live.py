"""State machines, streams, files and the store."""

import json

import pytest
from pyspark.sql import functions as F

from memlake.sources import files
from memlake.sources.store import Store
from memlake.streaming import pipeline, steps


def fires(times, dwell=0.0, cooldown=300.0, zone=lambda t: True, verify=None):
    state, out = {}, []
    for t in times:
        if steps.rule(state, float(t), True, zone(t), dwell, cooldown, verify):
            out.append(t)
    return out


def test_rule_dwell_cooldown_and_gaps():
    assert fires(range(0, 20), dwell=10) == [10]
    assert fires(range(0, 700), dwell=10) == [10, 310, 610]
    assert fires([0, 4, 8, 20, 24, 28, 32], dwell=10) == [32]  # out of sight for more than five seconds starts anew
    assert fires(range(0, 20), dwell=10, zone=lambda t: t != 9) == []
    assert fires([0, 1], cooldown=0) == [0, 1]


def test_rule_check_is_asked_rarely():
    asked = []
    assert fires(range(0, 70), verify=lambda: asked.append(1) or "no") == [] and len(asked) == 3
    assert fires([0], verify=lambda: "yes") == [0]


def test_presence_settle_and_trigger():
    state = {}
    assert [t for t in (0.0, 5.0, 10.0, 3.0, 21.0) if steps.presence(state, t)] == [0.0, 10.0, 21.0]
    state = {}
    assert [i for i, m in enumerate([0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0]) if steps.settle(state, bool(m))] == [7]
    state = {}
    got = [steps.trigger(state, t, c, s, m, False) for t, c, s, m in [(0.0, True, "a", True), (1.0, False, "a", False), (2.0, True, "a", False), (40.0, False, "a", False)]]
    assert got == [False, True, False, True]


BOX = "camera_id string, frame_index bigint, ts double, entity_id string, cls string, conf double, source_ref string, location_id string, bbox struct<x1:int,y1:int,x2:int,y2:int>"


@pytest.fixture(scope="module")
def detections(spark):
    rows = []
    for i in range(30):
        rows.append(("cam", i, float(i), "ent_p", "person", 0.995, None, None, (0, 0, 10, 20)))
        rows.append(("cam", i, float(i), "ent_v", "forklift", 0.5, None, None, (8, 0, 20, 20)))
        rows.append(("cam", i, float(i), "ent_far", "forklift", 0.5, None, None, (900, 0, 920, 20)))
    return spark.createDataFrame(rows, BOX)


def test_observe_replay(detections):
    got = sorted((r.subject_entity_id, r.predicate, r.object_entity_id or "", r.ts) for r in pipeline.observe(pipeline.sightings(detections)).collect())
    assert [g[3] for g in got if g[:2] == ("ent_p", "near")] == [0.0, 10.0, 20.0]
    assert {g[2] for g in got if g[1] == "near"} == {"ent_v"} and len(got) == 12


def test_observe_stream_equals_replay(spark, detections, tmp_path):
    src, sink = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    rows = pipeline.sightings(detections)
    for lo, hi in ((0, 12), (12, 30)):
        rows.where(F.col("ts").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(src)
    live = pipeline.observe(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src))
    q = live.writeStream.foreachBatch(pipeline.append_to(sink, "observations")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in pipeline.observe(rows).select("observation_id", "ts").collect()}
    assert {tuple(r) for r in sink.read("observations").select("observation_id", "ts").collect()} == want


def test_rules_over_detections(spark, detections):
    zones = spark.createDataFrame([("loc_1", "ramp", [(0.0, 0.0), (12.0, 0.0), (12.0, 40.0), (0.0, 40.0)], "cam")], "location_id string, name string, polygon array<struct<x:double,y:double>>, camera_id string")
    rules = files.parse_rules({"rules": [{"name": "dwell", "trigger": {"class": "person", "zone": "ramp"}, "gate": {"dwell_seconds": 10}}, {"name": "off", "enabled": False, "trigger": {}}, {"name": "lost", "trigger": {"zone": "nowhere"}}]})
    armed = spark.createDataFrame(rules, files.RULES)
    got = pipeline.fire_rules(pipeline.in_zones(detections.drop("location_id"), zones), armed, zones).collect()
    assert [(r.predicate, r.ts, r.location_id, r.camera_id) for r in got] == [("rule_fired:dwell", 10.0, "loc_1", "cam")]
    assert [r.name for r in files.never_firing(armed, zones).collect()] == ["lost"]


def test_inventories_and_triggers(detections):
    inv = pipeline.inventories(detections.withColumn("location_id", F.lit("z")), 15)
    assert sorted((r.ts, r.present_entity_ids) for r in inv.collect()) == [(0.0, ["ent_far", "ent_p", "ent_v"]), (15.0, ["ent_far", "ent_p", "ent_v"])]
    scenes = pipeline.scene_signatures(detections).withColumn("moving", F.lit(False)).withColumn("settled", F.lit(False))
    assert [r.ts for r in pipeline.triggers(scenes).collect()] == [0.0]


def test_tracks(spark):
    rows = [("c", 0, 0.0, 1, "chair", [1.0, 0.0]), ("c", 1, 1.0, 1, "chair", [0.0, 1.0]), ("c", 2, 2.0, 2, "chair", [0.9, 0.1]), ("c", 3, 3.0, 3, "dog", [1.0, 0.0]), ("c", 4, 4.0, 4, "dog", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "camera_id string, frame_index bigint, ts double, track_id bigint, cls string, appearance array<double>")
    got = {r.frame_index: r.entity_id for r in pipeline.bind_tracks(df).collect()}
    assert got[0] == got[1] == got[2] and got[3] != got[4]


def test_zone_and_rule_files(spark, tmp_path):
    z = tmp_path / "zones.json"
    z.write_text(json.dumps({"zones": [{"name": "bay", "polygon": [[0, 0], [1, 0], [1, 1]]}]}))
    row = files.read_zones(spark, str(z)).first()
    assert row.name == "bay" and row.polygon[1].x == 1.0 and row.location_id.startswith("loc_")
    assert files.read_rules(spark, str(tmp_path / "none.yaml")).count() == 0
    r = tmp_path / "rules.yaml"
    r.write_text("rules:\n- name: a\n  trigger: {class: person}\n  verify: {prompt: \"smoking?\"}\n")
    got = files.read_rules(spark, str(r)).first()
    assert (got.cooldown_seconds, got.severity, got.verify_prompt, got.enabled) == (300.0, "medium", "smoking?", True)
    with pytest.raises(ValueError):
        files.resolve_cameras([{"name": "a"}, {"name": "a"}])
    assert files.gate_rule({"feasible": True, "targets_individual": True})["refused"] == "needs_identity"
    assert files.settings({"a": 1, "b": 2}, {"a": 3}, {"b": None}) == {"a": 3, "b": 2}


def test_store(spark, tmp_path, observations, entities):
    s = Store(spark, str(tmp_path / "s"))
    assert s.read("observations").count() == 0
    s.append("observations", observations([{"observation_id": "1", "ts": 5.0, "origin": "rule"}, {"observation_id": "2", "ts": 90000.0}]))
    s.attach("observations", observations([{"observation_id": "2", "ts": 1.0}, {"observation_id": "3", "ts": 2.0}]))
    got = {r.observation_id: (r.status, str(r.event_date)) for r in s.read("observations").collect()}
    assert got == {"1": ("new", "1970-01-01"), "2": (None, "1970-01-02"), "3": (None, "1970-01-01")}
    s.upsert("entities", entities([{"entity_id": "a", "type": "person", "created_at": 1.0}]))
    s.upsert("entities", entities([{"entity_id": "a", "type": "person", "label": "Ann", "created_at": 3.0}, {"entity_id": "a", "type": "person", "label": "Old", "created_at": 2.0}]), newest="created_at")
    assert [r.label for r in s.read("entities").collect()] == ["Ann"]
    s.update("entities", F.col("entity_id") == "a", status=F.lit("deleted"))
    assert s.read("entities").first().status == "deleted"
    s.delete("observations", F.col("ts") > 100)
    assert s.read("observations").count() == 2
    s.vacuum("entities")
    s.export(str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy/entities.parquet")).count() == 1
    with pytest.raises(Exception, match="entities.type"):
        s.append("entities", entities([{"entity_id": "b", "type": "ghost"}]))
