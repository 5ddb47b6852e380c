"""Search, fusion, mining, corrections, identity and reports on small cases."""

import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.functions.porter import stem
from memlake.operators import corrections, digest, identity, lexical, mining, ranking, reports, semantic

TEXTS = [
    "Smoking near the gate", "a worker smokes; rule fired twice", "rule_fired again", "fired the rule", None, "", "café au lait cafe",
    "carrying crates and carried crates", "relational conditional rationality hopping hoping", "generalizations oscillators", "x" * 4000,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(f"d{i:02d}", t) for i, t in enumerate(TEXTS)], "doc string, text string")


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", list(enumerate(TEXTS)))
    return con


@pytest.mark.parametrize("query", ["smoke", "gate smoking", "rule_fired", "cafe", "crate carry", "hop", "generalization", "the", "nothing here", "the rule"])
def test_search_equals_sqlite(docs, fts, query):
    kept = [w for w in query.split() if w not in lexical.STOPWORDS] or query.split()
    match = " ".join(f'"{w}"' for w in kept)
    want = {f"d{i:02d}": -s for i, s in fts.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
    got = {r.doc: r.score for r in lexical.search(docs, "doc", query).collect()}
    assert got == pytest.approx(want)


def test_stems_equal_sqlite(fts):
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized falling hissing failing filing happy sky vietnamization predication digitizer radically vileness decisiveness hopefulness formality sensibility triplicate formative electricity goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption homologous communism activate effective bowdlerize probate rate cease controlling rolling".split()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, row)")
    for w in words:
        con.execute("DELETE FROM t")
        con.execute("INSERT INTO t VALUES (?)", (w,))
        assert con.execute("SELECT term FROM v").fetchone()[0] == stem(w), w


def test_search_of_nothing(docs, spark):
    assert lexical.search(docs, "doc", "").count() == 0
    assert lexical.search(docs.limit(0), "doc", "smoke").count() == 0


def test_hard_filters_come_before_the_cut(docs):
    assert [r.doc for r in lexical.search(docs, "doc", "fired", F.col("doc") == "d03", limit=1).collect()] == ["d03"]


def test_cosine_floor_ties_and_lengths(spark):
    rows = [("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0]), ("d", [1.0, 0.0, 0.0]), ("z", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "ref_id string, vec array<float>")
    assert [(r[0], round(r[1], 6)) for r in semantic.cosine_topk(df, [1.0, 0.0]).collect()] == [("a", 1.0), ("b", 1.0)]


def test_encode_and_backlog(spark, observations):
    enc = semantic.hashing_encoder(64)
    obs = observations([{"observation_id": "o1", "text": "gate open", "ts": 1.0}, {"observation_id": "o2", "text": " ", "ts": 2.0}, {"observation_id": "o3", "text": "spill", "ts": 3.0}])
    done = semantic.encode_texts(obs.where("observation_id = 'o1'"), enc, "observation", "m", 0.0, key="observation_id")
    assert [r.observation_id for r in semantic.backlog(obs.where("text != ' '"), done, "observation", "m", "observation_id").collect()] == ["o3"]
    assert done.first().dim == 64
    assert [r[0] for r in semantic.search(obs, done, semantic.query_vector(enc, "gate open")).collect()] == ["o1"]


def test_fusion_keeps_order_of_one_list_and_says_why(spark):
    a = ranking.ranked(spark.createDataFrame([("x", 3.0), ("y", 2.0), ("z", 2.0)], "observation_id string, score double"))
    b = ranking.ranked(spark.createDataFrame([("z", 9.0)], "observation_id string, score double"))
    one = [r.observation_id for r in ranking.fuse(lexical=a).orderBy(F.desc("score")).collect()]
    assert one == ["x", "y", "z"]
    got = {r.observation_id: (round(r.score, 9), r.reason) for r in ranking.fuse(lexical=a, semantic=b).collect()}
    assert got["z"] == (round(1 / 63 + 1 / 61, 9), "both") and got["x"][1] == "lexical"


def test_rerank_never_changes_the_set(spark):
    fused = spark.createDataFrame([(f"o{i}", 1.0 / (60 + i)) for i in range(80)], "observation_id string, score double")
    seen = spark.createDataFrame([("o3", 0.9), ("stranger", 0.99), ("o79", 0.8)], "observation_id string, similarity double")
    got = ranking.rerank(fused, seen).collect()
    assert {r.observation_id for r in got} == {f"o{i}" for i in range(80)}
    assert {r.observation_id for r in got if r.reranked} == {"o3"}  # o79 is not in the head


def test_spread_keeps_the_ends(spark):
    rows = [("e", float(i), f"u{i}") for i in range(10)] + [("f", 1.0, "only")]
    df = spark.createDataFrame(rows, "entity_id string, ts double, url string")
    got = {r[0]: r[1] for r in ranking.pick_spread(df, "entity_id", "url", 4).collect()}
    assert got == {"e": ["u0", "u3", "u6", "u9"], "f": ["only"]}
    assert {r[0]: r[1] for r in ranking.pick_spread(df, "entity_id", "url", 1).collect()}["e"] == ["u0"]


def edge(**k):
    base = dict(kind="relation", subject_entity_id="a", predicate="uses", object_entity_id="b", location_id=None, times=1, confidence=0.8, evidence=["o1"])
    return tuple((base | k)[c] for c in ("kind", "subject_entity_id", "predicate", "object_entity_id", "location_id", "times", "confidence", "evidence"))


SCHEMA = "kind string, subject_entity_id string, predicate string, object_entity_id string, location_id string, times bigint, confidence double, evidence array<string>"


def test_reinforce_n_times_is_one_scaled(spark):
    none = mining.empty_relations(spark)
    at_once = mining.reinforce(none, spark.createDataFrame([edge(times=4)], SCHEMA), 5.0)
    step = none
    for _ in range(4):
        step = mining.reinforce(step, spark.createDataFrame([edge()], SCHEMA), 5.0)
    assert at_once.first().weight == pytest.approx(step.first().weight) and step.count() == 1


def test_confirmation_cap_and_suppression(spark):
    found = mining.reinforce(mining.empty_relations(spark), spark.createDataFrame([edge(times=5), edge(predicate="frequents", object_entity_id=None, location_id="l", times=99)], SCHEMA), 5.0)
    rows = {r.predicate: r for r in found.collect()}
    assert rows["uses"].status == "confirmed" and rows["uses"].weight >= 0.6  # 0.15 * 0.8 * 5 lands on the line
    assert rows["frequents"].weight == 1.0
    gone = mining.suppress(found, rows["uses"].relation_id)
    again = mining.reinforce(gone, spark.createDataFrame([edge(times=5, evidence=["o9"])], SCHEMA), 9.0)
    kept = {r.predicate: r for r in again.collect()}["uses"]
    assert (kept.weight, kept.status, kept.supporting_observation_ids) == (0.0, "suppressed", ["o1"])


def test_decay_compounds_and_takes_back(spark):
    found = mining.reinforce(mining.empty_relations(spark), spark.createDataFrame([edge(times=5)], SCHEMA), 0.0)
    once = mining.decay(found, C.HALF_LIFE_DAYS * 86400)
    assert once.first().weight == pytest.approx(0.3) and once.first().status == "candidate"
    assert mining.decay(once, C.HALF_LIFE_DAYS * 86400).first().weight == pytest.approx(0.15)
    assert mining.decay(found, -5.0).first().weight == pytest.approx(0.6)


def test_changes(spark):
    rows = [(f"s{i}", i, "z", float(i), ids) for i, ids in enumerate([["a"], ["a", "b"], [], [], ["c"]])] + [("t0", 0, "lone", 0.0, ["x"])]
    df = spark.createDataFrame(rows, "snapshot_id string, seq bigint, location_id string, ts double, present_entity_ids array<string>")
    got = {(r.entity_id, r.kind): (r.ts, r.evidence) for r in mining.changes(df).collect()}
    assert got == {("b", "new"): (1.0, ["s1"]), ("c", "new"): (4.0, ["s4"]), ("a", "gone"): (4.0, ["s2", "s3", "s4"]), ("b", "gone"): (4.0, ["s2", "s3", "s4"])}


def test_merge_and_delete(spark, observations, entities):
    obs = observations([{"observation_id": "1", "subject_entity_id": "a", "object_entity_id": "c"}, {"observation_id": "2", "subject_entity_id": "b"}])
    ents = entities([{"entity_id": x, "type": "person", "label": x, "status": "active"} for x in "abc"])
    shots = spark.createDataFrame([("s", 1, "l", 1.0, ["a", "b"])], "snapshot_id string, seq bigint, location_id string, ts double, present_entity_ids array<string>")
    moves = spark.createDataFrame([("a", "b")], "src string, dst string")
    out = corrections.merge({"observations": obs, "entities": ents, "scene_snapshots": shots}, moves)
    assert {r.subject_entity_id for r in out["observations"].collect()} == {"b"}
    assert out["scene_snapshots"].first().present_entity_ids == ["b"]
    assert {r.entity_id: r.status for r in out["entities"].collect()}["a"] == "merged_into:b"
    emb = spark.createDataFrame([("observation", "1"), ("keyframe", "1"), ("keyframe", "2")], "kind string, ref_id string")
    left, counts = corrections.cascade_delete({"observations": obs, "entities": ents, "text_embeddings": emb, "scene_snapshots": shots}, "c")
    assert {r[0]: r[1] for r in counts.collect()} == {"embeddings": 2, "observations": 1}
    assert left["text_embeddings"].count() == 1 and {r.entity_id: r.label for r in left["entities"].collect()}["c"] is None


def test_least_labels_and_survivors(spark, observations, entities):
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("x", "y")], "a string, b string")
    got = {r.id: r.root for r in corrections.least_labels(chain).collect()}
    assert {got[f"n{i:02d}"] for i in range(21)} == {"n00"} and got["y"] == "x"
    ents = entities([{"entity_id": "x", "type": "person"}, {"entity_id": "y", "type": "person", "label": "Yan"}])
    moves = corrections.merge_moves(spark.createDataFrame([("x", "y")], "a string, b string"), ents, observations([{"observation_id": "1", "subject_entity_id": "x"}]))
    assert [tuple(r) for r in moves.collect()] == [("x", "y")]


def test_match_or_mint(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((3, 32))
    faces = [(f"f{i}", float(i), (base[i % 3] + 0.05 * rng.standard_normal(32)).tolist()) for i in range(9)]
    df = spark.createDataFrame(faces, "face_id string, ts double, vec array<double>")
    empty = spark.createDataFrame([], "entity_id string, sig_id string, vec array<double>, created_at double")
    got = sorted(identity.match_or_mint(df, empty).collect(), key=lambda r: r.face_id)
    assert [r.entity_id for r in got] == ["ent_f0", "ent_f1", "ent_f2"] * 3 and [r.minted for r in got] == [True] * 3 + [False] * 6


def test_report_facts_and_observations(spark):
    raw = {"people": [{"ref": "ent_1", "state": "waiting", "context_analysis": ""}, {"ref": None, "state": "alone"}], "notable": ["spill", ""], "objects": [{"label": " gate ", "description": "open"}, {"label": ""}], "locations": [{"location": "bay", "contents": ["crate", " "]}, {"location": "", "contents": ["drum"]}]}
    rows = [("d1", "cam", "loc", 5.0, "k.jpg", "m", json.dumps(raw), ""), ("d2", "cam", None, 6.0, None, "m", "not json", ""), ("d3", None, None, 6.0, None, "m", None, "")]
    df = spark.createDataFrame(rows, "description_id string, camera_id string, location_id string, ts double, source_ref string, model string, raw string, text string")
    facts = [(r.predicate, r.text) for r in reports.report_facts(df).orderBy("description_id", "i").collect()]
    assert facts == [("state:waiting", "waiting"), ("state:alone", "alone"), ("spill", "spill"), ("object:gate — open", "gate — open"), ("area:bay — crate", "crate in bay"), ("area:drum", "drum")]
    assert reports.flattened(df).first().text == "waiting | alone | spill | gate — open | crate in bay | drum"
    zones = spark.createDataFrame([("loc_bay", "bay")], "location_id string, name string")
    got = {(r.subject_entity_id, r.predicate) for r in reports.report_observations(df, zones).collect()}
    assert got == {("ent_1", "state:waiting"), ("scene:loc", "object:gate — open"), ("scene:loc_bay", "area:bay — crate"), ("scene:loc", "area:drum")}


def test_digest_and_renderers(spark, observations, entities):
    day = 86400.0
    obs = [{"observation_id": f"p{i}", "seq": i, "subject_entity_id": "ent_a", "predicate": "present", "location_id": "l", "ts": i * day + 9 * 3600, "origin": "detector"} for i in range(3)]
    obs += [
        {"observation_id": "odd", "seq": 9, "subject_entity_id": "ent_a", "predicate": "present", "location_id": "l", "ts": 2 * day + 15 * 3600, "origin": "detector", "source_ref": "x/odd.jpg"},
        {"observation_id": "fire", "seq": 10, "subject_entity_id": "ent_a", "predicate": "rule_fired:loiter", "ts": 2 * day + 15.5 * 3600, "origin": "rule"},
        {"observation_id": "tri", "seq": 11, "subject_entity_id": "ent_a", "predicate": "digest:dismissed:first_seen:ent_b", "ts": 1.0, "origin": "operator"},
    ]
    ents = entities([{"entity_id": "ent_a", "type": "person", "label": "<Ann>", "created_at": 0.0, "status": "active"}, {"entity_id": "ent_b", "type": "object", "created_at": 2.5 * day, "status": "active"}, {"entity_id": "ent_c", "type": "object", "created_at": 2.6 * day, "status": "active"}])
    locs = spark.createDataFrame([("l", "bay")], "location_id string, name string")
    o = observations(obs)
    rel = mining.reinforce(mining.empty_relations(spark), mining.habits(o.where("observation_id LIKE 'p%'")), 0.0)
    d = digest.build(o, ents, ents, locs, rel, 2 * day, 3 * day)
    assert {r.signature for r in d.items.collect()} == {"rule:loiter:ent_a:228600", "first_seen:ent_c", "unusual_hour:ent_a:l:15"}
    assert d.histogram.count() == 30 and {r.type for r in d.histogram.collect()} == {"f", "u", "r"}
    csv_text, html = reports.render_csv(d), reports.render_html(d)
    assert csv_text.startswith("SUMMARY") and "odd.jpg" in csv_text and "&lt;Ann&gt;" in html
    assert "Rule fired: loiter" in reports.render_text(d)


def _faces_folder(spark, entities, tmp_path, faces):
    """A folder with active persons and their face signatures, (sig_id, entity_id, vec) in order of time."""
    rows = [(i, e, "face", len(v), v, float(t)) for t, (i, e, v) in enumerate(faces)]
    spark.createDataFrame(rows, "sig_id string, entity_id string, kind string, dim int, vec array<float>, created_at double").write.parquet(f"{tmp_path}/signatures.parquet")
    who = [{"entity_id": e, "type": "person", "label": "", "created_at": 0.0, "status": "active"} for e in sorted({e for _, e, _ in faces})]
    entities(who).write.parquet(f"{tmp_path}/entities.parquet")
    return str(tmp_path)


def test_merges_look_at_all_signatures(spark, entities, observations, tmp_path):
    from memlake.plans import memory_queries

    eye = np.eye(16).tolist()
    faces = [("s00", "ent_a", eye[0]), ("s01", "ent_b", eye[0])]  # the oldest ones are alike, four newer ones aren't
    faces += [(f"s{k:02d}", "ent_a" if k % 2 else "ent_b", eye[k]) for k in range(2, 10)]
    folder = _faces_folder(spark, entities, tmp_path, faces)
    observations([{"observation_id": "o", "seq": 1, "subject_entity_id": "ent_b", "predicate": "p", "ts": 1.0}]).write.parquet(f"{folder}/observations.parquet")
    assert [tuple(r) for r in memory_queries.merge_suggestions(spark, folder).collect()] == [("ent_a", "ent_b", 1.0)]
    assert [tuple(r) for r in memory_queries.auto_merge_moves(spark, folder).collect()] == [("ent_a", "ent_b")]


def test_match_or_mint_takes_every_row(spark, tmp_path):
    from memlake.plans import memory_queries

    rng = np.random.default_rng(7)
    base = rng.standard_normal((40, 64))
    rows = [(i, int(i % 40 if i < 30 else 0), (base[i % 40] + 0.4 * rng.standard_normal(64)).tolist()) for i in range(450)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {int(r.face_id): r for r in memory_queries.match_or_mint(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(450))
    known = {}  # the fold again, a list of vectors a person
    for i, label, vec in rows:
        if i < 30:
            known.setdefault(str(label), []).append(np.asarray(vec, np.float32).astype(float))
    for i, _, vec in rows:
        v = np.asarray(vec, np.float32).astype(float)
        v /= np.linalg.norm(v)
        sim, who = max((max(float(v @ x) for x in xs), e) for e, xs in known.items())
        if sim < 0.3:
            who = f"ent_{i}"
        if sim < 0.3 or 1 - sim >= 0.1:
            known[who] = [*known.get(who, []), v][-12:]
        assert got[i].entity_id == who and got[i].minted == (sim < 0.3)


def test_best_match_asks_every_face(spark, entities, tmp_path, monkeypatch):
    from memlake.plans import memory_queries

    monkeypatch.setattr(identity, "BLOCK", 7)
    monkeypatch.setattr(identity, "PROBES", 9)
    x = np.random.default_rng(9).standard_normal((30, 16))
    ids = [f"sig_{i % 4:x}{i:03d}" for i in range(30)]
    folder = _faces_folder(spark, entities, tmp_path, [(ids[i], f"ent_{i % 6}", v.tolist()) for i, v in enumerate(x)])
    got = {r.probe_id: (r.entity_id, r.similarity) for r in memory_queries.best_match(spark, folder).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert sorted(got) == sorted(ids)
    assert all(got[ids[i]][0] == f"ent_{s[i].argmax() % 6}" and abs(got[ids[i]][1] - s[i].max()) < 0.001 for i in range(30))


def test_search_without_a_limit_gives_all(spark):
    from memlake.operators import lexical

    docs = spark.range(1200).selectExpr("CAST(id AS string) AS doc", "'crate ramp' AS text")
    assert lexical.search(docs, "doc", "crate ramp", limit=None).count() == 1200
