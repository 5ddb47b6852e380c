"""Nearest vectors: recall against brute force, copies, ties and dirt."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memlake.llm import ann, hnsw
from memlake.llm.ann import nearest, nearest_of, similar_pairs
from memlake.llm.hnsw import Graph

SIG = "sig_id string, entity_id string, kind string, dim int, vec array<float>, created_at double"


def clustered(n, dim, seed, size=8):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // size, dim))
    x = np.repeat(centres, size, 0) + 0.35 * rng.standard_normal((n // size * size, dim))
    return rng.permutation(x).astype(np.float32)


def brute(x, k, floor):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i, row in enumerate(s):
        out |= {(min(i, j), max(i, j)) for j in np.argsort(-row, kind="stable")[:k].tolist() if row[j] >= floor}
    return out


def test_graph_finds_what_is_near():
    x = clustered(3000, 48, 1)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(u)
    found = {(min(i, j), max(i, j)) for a, b, _ in g.insert_all(0.8) for i, j in zip(a.tolist(), b.tolist())}
    s = np.triu(u @ u.T, 1)
    want = set(zip(*(c.tolist() for c in np.nonzero(s >= 0.8))))
    assert len(found & want) / len(want) > 0.97 and not {p for p in found - want if s[p] < 0.799}
    ids, _ = g.search(u[:200])
    assert (ids == np.arange(200)[:, None]).any(1).mean() > 0.97


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_graph_of_few(n):
    x = np.eye(8, dtype=np.float32)[:n]
    assert list(Graph(x).insert_all(0.8)) == []


def test_recall_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "ONE_SHARD", 500)
    x = clustered(4000, 48, 2)
    df = spark.createDataFrame([(f"sig_{i:05d}", "e", "face", 48, v.tolist(), 0.0) for i, v in enumerate(x)], SIG)
    got = {(int(a[4:]), int(b[4:])) for a, b in (tuple(r) for r in similar_pairs(df).collect())}
    want = brute(x, 10, 0.8)
    assert len(got & want) / len(want) >= 0.95 and len(got - want) <= 0.05 * len(want)


def test_recall_over_small_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "ONE_SHARD", 200)
    monkeypatch.setattr(ann, "SHARD_ROWS", 60)
    monkeypatch.setattr(ann, "FLAT", 16)
    monkeypatch.setattr(ann, "FANOUT", 8)
    x = clustered(1200, 32, 3)
    df = spark.createDataFrame([(f"sig_{i:05d}", "e", "face", 32, v.tolist(), 0.0) for i, v in enumerate(x)], SIG)
    got = {(int(a[4:]), int(b[4:])) for a, b in (tuple(r) for r in similar_pairs(df).collect())}
    want = brute(x, 10, 0.8)
    assert len(got & want) / len(want) >= 0.95


def test_routing_of_a_billion(monkeypatch):
    assert ann.pivots_of(10**8) * ann.SHARD_ROWS >= 10**8 * ann.COPIES and ann.COPIES * 10**9 / ann.pivots_of(10**9) < 25_000
    x = clustered(60_000, 32, 11, size=12)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hot = u[0] + 0.02 * np.random.default_rng(1).standard_normal((30_000, 32)).astype(np.float32)  # a third of all rows, nearly alike
    u = np.random.default_rng(2).permutation(np.concatenate([u, hot / np.linalg.norm(hot, axis=1, keepdims=True)]))
    monkeypatch.setattr(ann, "pivots_of", lambda n: 6000)
    way = ann.Routing(len(u), u[:7000])
    assert way.pivots.above is not None and len(way.pivots.x) == 6000
    q = u[20_000:50_000]
    r, shard = way.shards(q)
    copies = np.bincount(r, minlength=len(q))
    assert copies.min() >= 1 and copies.max() <= ann.SHARDS_AT_MOST
    size = np.bincount(shard, minlength=6000)
    assert size.max() <= 60 * size.mean()
    best = np.concatenate([(q[i : i + 500] @ way.pivots.x.T).argmax(1) for i in range(0, 5000, 500)])
    assert np.mean([b in set(shard[r == i].tolist()) for i, b in enumerate(best.tolist())]) >= 0.95


def test_dirt_copies_ties_and_kinds(spark):
    nan, one = float("nan"), [1.0, 0.0, 0.0]
    rows = [
        ("s1", "a", "face", 3, one, 0.0), ("s1", "a", "face", 3, one, 0.0), ("s2", "b", "face", 3, [2.0, 0.1, 0.0], 0.0),
        ("s3", "c", "body", 3, one, 0.0), ("s4", "c", "face", 3, [0.0, 0.0, 0.0], 0.0), ("s5", "c", "face", 3, [nan, 1.0, 0.0], 0.0),
        ("s6", "c", "face", 3, [1.0, 0.0], 0.0), ("s7", "c", "face", 3, [], 0.0), ("s8", "c", "face", 3, None, 0.0), ("s9", "c", "face", 3, [1.0, None, 0.0], 0.0),
        ("sA", "c", None, 3, one, 0.0), ("sB", "c", "face", None, one, 0.0), ("sC", "d", "face", 3, [0.0, 1.0, 0.0], 0.0), (None, "d", "face", 3, one, 0.0),
        ("sD", "d", "face", 3, [0.0, 0.0, 0.0], 0.0),
    ]
    df = spark.createDataFrame(rows, SIG)
    assert [tuple(r) for r in similar_pairs(df).collect()] == [("s1", "s2")]
    assert similar_pairs(df.limit(0)).count() == 0


def test_many_copies_stay_linear(spark):
    rows = [(f"s{i:03d}", "a", "face", 2, [1.0, 0.5], 0.0) for i in range(300)] + [("t", "b", "face", 2, [1.0, 0.52], 0.0)]
    got = nearest(spark.createDataFrame(rows, SIG), k=3).collect()
    by = {}
    for r in got:
        by.setdefault(r.sig_id, []).append((r.rank, r.neighbour))
    assert len(by) == 301 and all(len(v) == 3 for v in by.values())
    assert [n for _, n in sorted(by["s000"])] == ["s001", "s002", "s003"] and [n for _, n in sorted(by["s200"])] == ["s000", "s001", "s002"]
    assert [n for _, n in sorted(by["t"])] == ["s000", "s001", "s002"]


def test_nearest_of_has_no_floor_and_is_exact(spark, monkeypatch, tmp_path):
    from memlake.llm import queries

    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    monkeypatch.setattr(ann, "ASKED_ROWS", 25)
    monkeypatch.setattr(ann, "TILE", 64)
    x = np.random.default_rng(5).standard_normal((1000, 48)).astype(np.float32)
    x[700] = x[0]
    rows = [(f"sig_{i:08x}", "e", "face" if i % 10 else "body", 48, v.tolist(), 0.0) for i, v in enumerate(x)]
    spark.createDataFrame(rows, SIG).write.parquet(f"{tmp_path}/signatures.parquet")
    got = {}
    for r in queries.p2_nearest(spark, str(tmp_path)).collect():
        got.setdefault(int(r.sig_id[4:], 16), {})[int(r.neighbour[4:], 16)] = r.similarity
    assert sorted(got) == list(range(0, 1000, 20)) and got[0][700] == 1.0
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i, found in got.items():
        sims = u @ u[i]
        sims[i] = -2
        sims[[j for j in range(1000) if (j % 10 == 0) != (i % 10 == 0)]] = -2
        best = np.argsort(-sims)[:10]
        assert set(found) == set(best.tolist()) and np.allclose([found[j] for j in best.tolist()], sims[best], atol=1e-5)


def test_nearest_of_asks_whom_it_is_told(spark):
    rows = [(f"s{i}", "a", "face", 2, [1.0, float(i)], 0.0) for i in range(4)]
    got = nearest_of(spark.createDataFrame(rows, SIG), F.col("sig_id") == "s0", k=2).orderBy("rank").collect()
    assert [(r.sig_id, r.neighbour, r["rank"]) for r in got] == [("s0", "s1", 1), ("s0", "s2", 2)]


@pytest.mark.parametrize("size,n", [(100, 1500), (400, 1500), (1000, 2900)])
def test_recall_in_large_groups_of_one_shard(spark, size, n):
    rng = np.random.default_rng(size)
    x = rng.standard_normal((n, 128)).astype(np.float32)
    x[rng.choice(n, size, False)] = rng.standard_normal(128) + 0.4 * rng.standard_normal((size, 128))
    df = spark.createDataFrame([(f"sig_{i:05d}", "e", "face", 128, v.tolist(), 0.0) for i, v in enumerate(x)], SIG)
    got = {(int(a[4:]), int(b[4:])) for a, b in (tuple(r) for r in similar_pairs(df).collect())}
    want = brute(x, 10, 0.8)
    assert len(got & want) / len(want) >= 0.97 and len(got - want) <= 0.03 * len(want)


def shard_of(x):
    u = np.rint(x / np.linalg.norm(x, axis=1, keepdims=True) * ann.GRAIN).astype(np.int16)
    vid = pa.array([i.to_bytes(4, "big") for i in range(len(x))], pa.binary())
    return pa.table({"space": ["face"] * len(x), "shard": [0] * len(x), "vid": vid, "unit": pa.array([v.tobytes() for v in u], pa.binary())})


def found_in(x):
    out = ann._search(0.8, 10)(shard_of(x))
    a, b = ([int.from_bytes(v, "big") for v in out[c].to_pylist()] for c in ("a", "b"))
    return {(min(p), max(p)) for p in zip(a, b)}


def test_a_shard_is_walked_once_in_and_once_asked(monkeypatch):
    calls, walk = [], hnsw.walk
    monkeypatch.setattr(hnsw, "walk", lambda x, layer, q, entry, ef: calls.append((ef, len(q))) or walk(x, layer, q, entry, ef))
    x = clustered(3000, 48, 7, size=12)  # every twelfth of them has more than half a beam of others
    got, want = found_in(x), brute(x, 10, 0.8)
    assert len(got & want) / len(want) >= 0.99
    assert {ef for ef, _ in calls} == {ann.BEAM, *ann.ASK[:2]}  # none through small layers
    again = [n for ef, n in calls if ef == ann.ASK[1]]
    assert sum(again) > 0 and len(again) == -(-sum(again) // ann.ASK_ROWS)  # the crowded ones of all parts together
    assert sum(n for ef, n in calls if ef == ann.ASK[0]) == len(x)


def test_layers_that_are_too_large_to_be_searched_whole(monkeypatch):
    x = clustered(3000, 48, 8)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(hnsw, "FLAT", 16)
    g = Graph(u)
    assert g.flat > 2 and len(g.layers[g.flat].links) <= 16 and sum(1 for _ in g.insert_all(0.8)) > 0
    ids, _ = g.search(u)
    assert (ids == np.arange(len(u))[:, None]).any(1).mean() > 0.97
    assert len(found_in(x) & brute(x, 10, 0.8)) / len(brute(x, 10, 0.8)) >= 0.99
