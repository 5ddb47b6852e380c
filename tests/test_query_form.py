"""Filters, plans, answers and the ladder."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memlake.plans import answer as A
from memlake.plans import ladder
from memlake.plans.filters import Filters
from memlake.plans.query_plan import INTENTS, QueryPlan, normalize_plan
from memlake.sources.memory import Memory

DAY = 86400.0


@pytest.fixture(scope="module")
def mem(spark, observations, entities):
    obs = []

    def add(subject, predicate, ts, **more):
        obs.append({"observation_id": f"obs_{len(obs):03d}", "seq": len(obs), "subject_entity_id": subject, "predicate": predicate, "ts": ts, "confidence": 0.9, "origin": "detector"} | more)

    add("ent_dave", "present", 1000.0, location_id="loc_bay", camera_id="cam_1", source_ref="k/a.jpg")
    add("ent_dave", "state:100%_sure", 1010.0, location_id="loc_bay", camera_id="cam_1", origin="vlm", text="smoking a cigarette", source_ref="k/b.jpg")
    add("ent_dave", "rule_fired:loiter", 1020.0, location_id="loc_bay", camera_id="cam_1", origin="rule", status="new", confidence=0.5)
    add("ent_nadia", "present", 2000.0, location_id="loc_gate", camera_id="cam_2", user_id="usr_1")
    add("ent_van000", "present", 3000.0, location_id="loc_gate", camera_id="cam_2")
    add("scene:loc_gate", "object:gate — open", 3000.0, location_id="loc_gate", origin="vlm")
    add("ent_ghost0", "present", 3500.0)
    add("ent_dave", "near", 4000.0, object_entity_id="ent_van000", location_id="loc_bay", confidence=0.7)
    obs.append(dict(obs[0]))
    ents = [
        {"entity_id": "ent_dave", "type": "person", "label": "Dave", "created_at": 1.0, "status": "active"},
        {"entity_id": "ent_nadia", "type": "person", "label": None, "created_at": 1.0, "status": "merged_into:ent_dave"},
        {"entity_id": "ent_van000", "type": "object", "label": "White Van", "created_at": 1.0, "status": "active"},
        {"entity_id": "ent_van000", "type": "object", "label": "Van", "created_at": 0.5, "status": "active"},
    ]
    locs = spark.createDataFrame(
        [("loc_bay", "Loading_Bay", None, "cam_1"), ("loc_gate", "side_gate", None, "cam_2")],
        "location_id string, name string, polygon array<struct<x:double,y:double>>, camera_id string",
    )
    return Memory(spark, "", observations=observations(obs), entities=entities(ents), locations=locs)


def ids(df):
    return [r[0] for r in df.select("observation_id").collect()]


def test_none_lifts_and_empty_matches_nothing(mem):
    assert mem.scan(Filters()).count() == 8
    for field in ("location_ids", "camera_ids", "entity_ids", "observation_ids", "origins", "predicate_prefixes"):
        assert mem.scan(Filters(**{field: []})).count() == 0, field
    for field in ("exclude_entity_ids", "exclude_predicates"):
        assert mem.scan(Filters(**{field: []})).count() == 8, field


def test_windows_include_both_ends(mem):
    assert ids(mem.scan(Filters(since=1000, until=1020), "asc")) == ["obs_000", "obs_001", "obs_002"]


def test_words_are_literal_and_without_case(mem):
    assert ids(mem.scan(Filters(predicate_contains="100%_S"))) == ["obs_001"]
    assert mem.scan(Filters(predicate_contains="1_0")).count() == 0
    assert ids(mem.scan(Filters(predicate_prefixes=["RULE_"]))) == ["obs_002"]


def test_words_or_ids(mem):
    f = Filters(predicate_contains="gate", observation_ids=["obs_000"], match_any=True)
    assert sorted(ids(mem.scan(f))) == ["obs_000", "obs_005"]
    assert ids(mem.scan(Filters(predicate_contains="gate", observation_ids=["obs_000"]))) == []


def test_order_is_total_and_checked(mem):
    assert ids(mem.scan(Filters(since=3000, until=3000), "desc")) == ["obs_005", "obs_004"]
    with pytest.raises(ValueError):
        mem.scan(Filters(), "sideways")


def test_owner(mem):
    assert mem.scan(Filters(user_id="usr_2")).count() == 7


def test_filters_reach_the_scan(spark, tmp_path, mem):
    mem.observations.write.parquet(str(tmp_path / "observations.parquet"))
    plan = Memory(spark, str(tmp_path)).scan(Filters(since=1, camera_ids=["cam_1"])).select("observation_id")
    text = plan._jdf.queryExecution().toString()
    assert "PushedFilters: [" in text and "GreaterThanOrEqual(ts" in text
    assert "assignee" not in text.split("ReadSchema:")[-1]


def test_old_shapes_become_plans():
    p = normalize_plan({"zone": "bay", "entity_label": "Dave", "limit": "0", "intent": "WHO ", "order": "up", "min_confidence": "x"})
    assert p == QueryPlan(zones=("bay",), entity_labels=("Dave",))
    assert normalize_plan(None) == QueryPlan()
    assert normalize_plan({"zones": "bay", "cameras": [" ", "c"], "limit": "3"}) == QueryPlan(zones=("bay",), cameras=("c",), limit=3)


@settings(deadline=None)
@given(st.dictionaries(st.sampled_from(["intent", "zones", "text", "limit", "order", "group_by", "min_confidence"]), st.one_of(st.none(), st.text(), st.integers(), st.lists(st.text()))))
def test_normalising_twice_changes_nothing(q):
    if isinstance(q.get("text"), (int, list)):
        q["text"] = None
    once = normalize_plan(q)
    assert normalize_plan(once) == once and once.intent in INTENTS


def run(mem, **plan):
    return [(r.entity_id, r.label, r.n_observations) for r in A.answer(mem, normalize_plan(plan)).entities.collect()]


def test_who(mem):
    assert run(mem) == [("ent_dave", "Dave", 4), ("ent_nadia", "Person _nadia"[:7] + "_nadia"[-6:], 1), ("ent_van000", "White Van", 1), ("scene:loc_gate", "side_gate", 1)]


def test_limit_counts_subjects_and_keeps_their_history(mem):
    assert run(mem, order="desc", limit=1) == [("ent_dave", "Dave", 4)]


def test_names_types_and_exclusions(mem):
    assert [e[0] for e in run(mem, entity_labels=["vAn"])] == ["ent_van000"]
    assert [e[0] for e in run(mem, entity_type="scene")] == ["scene:loc_gate"]
    assert [e[0] for e in run(mem, exclude_entity_labels=["dave", "gate"])] == ["ent_nadia", "ent_van000"]
    assert run(mem, zones=["car park"]) == []
    assert [e[0] for e in run(mem, zones=["LOADING_bay"])] == ["ent_dave"]


def test_scores_rank_and_null_ones_come_last(mem, spark):
    scores = spark.createDataFrame([("obs_003", 0.2, "lexical"), ("obs_001", 0.5, "semantic"), ("obs_000", 0.1, "lexical")], "observation_id string, score double, reason string")
    found = A.answer(mem, normalize_plan({"text": "smoking"}), scores=scores)
    assert [(r.entity_id, r.match_reason) for r in found.entities.collect()] == [("ent_dave", "both"), ("ent_nadia", "lexical")]
    found = A.answer(mem, normalize_plan({"predicate_contains": "present"}), scores=scores)
    assert [r.entity_id for r in found.entities.collect()] == ["ent_dave", "ent_nadia", "ent_van000"]


def test_details(mem):
    plan = normalize_plan({"zones": ["loading_bay"]})
    rows = A.matched_rows(mem, plan)
    got = A.with_details(mem, plan, A.answer(mem, plan), rows).first()
    assert got.states == ["state:100%_sure"] and got.keyframes == ["/keyframe/a.jpg", "/keyframe/b.jpg"] and got.hits is None
    assert A.answer(mem, plan).rule_events.first().rule == "loiter"


def test_who_with(mem, spark):
    shots = spark.createDataFrame([("s1", 1, "loc_bay", 5.0, ["ent_dave", "ent_van000"]), ("s2", 2, "loc_bay", 6.0, ["ent_dave"]), ("s3", 3, "loc_gate", 7.0, ["ent_dave", "ent_nadia", "ent_van000"])], "snapshot_id string, seq bigint, location_id string, ts double, present_entity_ids array<string>")
    m = Memory(spark, "", observations=mem.observations, entities=mem.table("entities"), locations=mem.locations, scene_snapshots=shots)
    found = A.answer(m, normalize_plan({"intent": "who_with", "entity_labels": ["dave"]}))
    assert [(r.entity_id, r.n_snapshots) for r in found.co_presence.collect()] == [("ent_van000", 2), ("ent_nadia", 1)]
    assert {r.entity_id for r in found.entities.collect()} == {"ent_van000", "ent_nadia"}
    assert A.answer(m, normalize_plan({"intent": "who_with", "entity_labels": ["nobody"]})).is_dead_end()


def test_ladder_loosens_the_gentlest_thing_that_finds_something(mem):
    go = lambda **q: ladder.execute(mem, normalize_plan(q), lambda p, _m: A.answer(mem, p))
    assert go(zones=["side_gate"], start=2000, end=2000).relaxation == {}
    wide = go(zones=["loading_bay"], start=500, end=900)
    assert wide.relaxation["answered_by"] == "widen_window" and wide.entities.first().entity_id == "ent_dave"
    zone = go(zones=["loading_bay"], entity_labels=["van"])
    assert zone.relaxation["answered_by"] == "drop_zone"
    none = go(zones=["atlantis"], entity_labels=["mallory"])
    assert none.is_dead_end() and none.relaxation == {"attempted": [], "answered_by": None, "loosened": None}


@pytest.mark.parametrize(("start", "end", "want"), [(None, None, None), (0.0, 100.0, (-150.0, 250.0)), (0.0, 10 * DAY, (-21600.0, 10 * DAY + 21600)), (5.0, None, (-21595.0, None)), (5.0, 5.0, (-21595.0, 21605.0))])
def test_widen(start, end, want):
    got = ladder.widen(QueryPlan(start=start, end=end))
    assert (None if got is None else (got.start, got.end)) == want
