"""Stored index, retrieval, the ladder's last rung, merge groups, versions of the store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.operators import corrections, lexical, mining
from memlake.plans import retrieval
from memlake.plans.query_plan import normalize_plan
from memlake.scratch import fresh_path
from memlake.sources.memory import Memory
from memlake.sources.store import Store

WORDS = ["red van at the gate", "a crate fell", "crates on the ramp", None, "", "red crate, red ramp", "the gate is open"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(WORDS)], "k string, text string")


def _scores(df):
    return {r.k: round(r.score, 9) for r in df.collect()}


def test_stored_index_equals_one_built_for_the_question(spark, docs):
    index = lexical.Postings(spark, fresh_path(spark, "index"), 4)
    assert lexical.search(docs, "k", "crate", postings=index).count() == 0  # nothing in it yet
    index.append(docs.limit(3), "k")
    index.append(docs, "k")
    index.append(docs.unionAll(docs).withColumn("bucket", F.lit("x")), "k")
    assert index.stats().first() == lexical.corpus_stats(docs, lexical.build_postings(docs, "k")).first()
    for query in ("crate", "red", "red crates", "the", "nothing like it", "", "red_van"):
        assert _scores(lexical.search(docs, "k", query, postings=index)) == _scores(lexical.search(docs, "k", query)), query
    index.append(docs.limit(0), "k")
    assert index.documents().count() == len(WORDS)


def test_a_question_reads_the_folders_of_its_terms(spark, docs):
    index = lexical.Postings(spark, fresh_path(spark, "index"), 32)
    index.append(docs, "k")
    rows = index.rows(["crate"])
    assert len(rows.inputFiles()) < len(index._postings().inputFiles()) or "PartitionFilters: [isnotnull(bucket" in rows._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def memory(spark, observations, entities):
    rows = [
        dict(observation_id=f"obs_{i}", seq=i, subject_entity_id=f"ent_{i % 3}", predicate=p, location_id="loc_a" if i < 3 else "loc_b", ts=100.0 + i, text=t, camera_id="cam")
        for i, (p, t) in enumerate([("note", "red van at the gate"), ("note", "a crate fell"), ("present", None), ("note", "crates on the ramp"), ("rule_fired:linger", None), ("note", "red crate")])
    ]
    people = [dict(entity_id=f"ent_{i}", type="person", label=n, status="active", created_at=0.0) for i, n in enumerate(("Ada", "Ben", "Cy"))]
    places = spark.createDataFrame([("loc_a", "Yard", None, "cam"), ("loc_b", "Ramp", None, "cam")], "location_id string, name string, polygon array<struct<x:double,y:double>>, camera_id string")
    return Memory(spark, "", observations=observations(rows + rows[:2]), entities=entities(people), locations=places)


def encoder(texts):
    """Two meanings: carrying, and everything else."""
    return np.array([[1.0, 0.0] if any(w in (t or "") for w in ("crate", "parcel")) else [0.0, 1.0] for t in texts])


@pytest.fixture(scope="module")
def index(spark, memory):
    rows = memory.scan().where("text IS NOT NULL").collect()
    vectors = [("observation", r.observation_id, "m", 2, encoder([r.text])[0].tolist(), 0.0) for r in rows]
    vectors += [("keyframe", "obs_3", "p", 2, [1.0, 0.0], 0.0), ("keyframe", "obs_9", "p", 2, [1.0, 0.0], 0.0)]
    return retrieval.SearchIndex(
        embeddings=spark.createDataFrame(vectors, "kind string, ref_id string, model string, dim int, vec array<float>, created_at double"),
        encoder=encoder, model="m", picture_encoder=encoder, picture_model="p",
    )


def test_retrieval_fuses_under_the_filters(memory, index):
    found = {r.observation_id: r for r in retrieval.retrieve(memory, normalize_plan({"text": "crate"}), index).collect()}
    assert set(found) == {"obs_1", "obs_3", "obs_5"} and {r.reason for r in found.values()} == {"both"}
    assert [i for i, r in found.items() if r.reranked] == ["obs_3"]
    ramp = retrieval.retrieve(memory, normalize_plan({"text": "crate", "zones": ["ramp"]}), index)
    assert {r.observation_id for r in ramp.collect()} == {"obs_3", "obs_5"}
    named = retrieval.retrieve(memory, normalize_plan({"text": "crate", "entity_labels": ["Ben"]}), index)
    assert {r.observation_id for r in named.collect()} == {"obs_1"}
    told = retrieval.trace(retrieval.retrieve(memory, normalize_plan({"text": "crate"}), index), index).first()
    assert (told.lexical, told.semantic, told.fused, told.reranked, told.semantic_index, told.visual_index) == (3, 3, 3, 1, 4, 2)


def test_retrieval_without_parts(memory):
    none = retrieval.SearchIndex()
    assert {r.observation_id for r in retrieval.retrieve(memory, normalize_plan({"text": "red"}), none).collect()} == {"obs_0", "obs_5"}
    assert retrieval.retrieve(memory, normalize_plan({"text": "red"}), none, meaning_only=True).count() == 0
    assert retrieval.retrieve(memory, normalize_plan({}), none).count() == 0


def test_the_last_rung_asks_for_meaning_alone(memory, index):
    plan = normalize_plan({"text": "parcel", "entity_labels": ["Cy"], "cameras": ["cam_other"]})
    found = retrieval.ask(memory, plan, index)
    assert found.relaxation["answered_by"] == "text_only" and {r.entity_id for r in found.entities.collect()} == {"ent_0", "ent_1", "ent_2"}
    assert [r.match_reason for r in found.entities.collect()] == ["semantic"] * 3
    told = retrieval.ask(memory, normalize_plan({"text": "crate", "zones": ["yard"]}), index)
    assert not told.relaxation and {r.entity_id for r in told.entities.collect()} == {"ent_1"}


def test_merge_groups_follow_chains_and_circles(entities):
    rows = [("ent_c", " Merged_Into: ENT_B "), ("ent_b", "merged_into:ent_a"), ("ent_a", "active"), ("ent_x", "merged_into:ent_y"), ("ent_y", "merged_into:ent_x")]
    rows += [("ent_s", "merged_into:ent_s"), ("ent_n", None), ("ent_c", "active"), ("ent_g", "merged_into:gone")]
    rows += [(f"ent_z{i:04d}", f"merged_into:ent_z{i + 1:04d}") for i in range(500)]
    got = {r.src: r.dst for r in corrections.told_moves(entities([dict(entity_id=i, status=s) for i, s in rows])).collect()}
    assert {k: v for k, v in got.items() if "_z" not in k} == {"ent_c": "ent_a", "ent_b": "ent_a", "ent_y": "ent_x", "gone": "ent_g"}
    assert {v for k, v in got.items() if "_z" in k} == {"ent_z0000"} and len(got) == 504
    assert corrections.told_moves(entities([])).count() == 0


def test_evidence_is_counted_and_listed_as_rows(spark, observations, entities):
    rows = [dict(observation_id=f"o{i}", seq=i, subject_entity_id="ent_a", predicate="present", location_id="loc", ts=86400.0 * (i % 4) + 3600 * 9) for i in range(12)]
    rows += [dict(observation_id=f"n{i}", seq=50 + i, subject_entity_id="ent_a", predicate="near", object_entity_id="ent_b", ts=1.0 * i) for i in range(3)]
    log, who = observations(rows), entities([dict(entity_id="ent_b", type="object", label="Dog", status="active")])
    found = mining.habits(log).unionByName(mining.relations(log, who))
    edges = mining.reinforce(mining.empty_relations(spark), found, 9.0)
    assert {(r.kind, r.predicate): r.n_evidence for r in edges.collect()} == {("habit", "present_around_09h"): 12, ("relation", "frequents"): 12, ("relation", "accompanied_by"): 3}
    assert edges.where("size(supporting_observation_ids) > 0").count() == 0
    listed = mining.evidence_rows(log, edges.select("relation_id", *mining.KEY), "ts")
    assert {(r.kind, r.predicate): r["count"] for r in listed.groupBy("kind", "predicate").count().collect()} == {k: 12 for k in (("habit", "present_around_09h"), ("relation", "frequents"))} | {("relation", "accompanied_by"): 3}
    assert set(listed.columns) == {"relation_id", *mining.KEY, "observation_id", "ts"}


def test_readers_see_one_version_or_the_next(spark, tmp_path, entities):
    store = Store(spark, str(tmp_path / "s"))
    store.append("entities", entities([dict(entity_id="a", type="person", status="active")]))
    before = store.read("entities")
    half = store.version("entities") + 1
    entities([dict(entity_id="b", type="person")]).write.parquet(store.path("entities", half))  # written, but not yet marked as whole
    assert [r.entity_id for r in store.read("entities").collect()] == ["a"]
    spark.read.parquet(store.path("entities", half))
    import shutil

    shutil.rmtree(store.path("entities", half))
    store.update("entities", F.col("entity_id") == "a", status=F.lit("deleted"))
    assert [r.status for r in before.collect()] == ["active"] and [r.status for r in store.read("entities").collect()] == ["deleted"]
    store.vacuum("entities")
    assert store.version("entities") == 1 and [r.status for r in store.read("entities").collect()] == ["deleted"]


def test_a_turn_names_its_thread(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.append("conversations", spark.createDataFrame([("c1", "u", "", 1.0, 1.0), ("c2", "u", "Old", 1.0, 1.0)], "conversation_id string, user_id string, title string, created_at double, updated_at double"))
    for k, (c, at, q) in enumerate([("c1", 5.0, "Who was at the gate?"), ("c1", 6.0, "And then?"), ("c2", 7.0, "Where?")]):
        store.append_turn(spark.createDataFrame([(f"t{k}", k, c, at, q)], "turn_id string, seq long, conversation_id string, asked_at double, question string"))
    got = {r.conversation_id: (r.title, r.updated_at) for r in store.read("conversations").collect()}
    assert got == {"c1": ("Who was at the gate?", 6.0), "c2": ("Old", 7.0)} and store.read("chat_turns").count() == 3
