"""Runs, components and n-gram counts against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memlake.llm.components import connected, merge_groups, merge_links
from memlake.llm.ngrams import ngram_counts, record_suffixes, term_records, terms, with_mark
from memlake.llm.runs import collapse_runs


def rows_of(seed, n=1200):
    rng = random.Random(seed)
    rows = [
        {
            "observation_id": f"obs_{i:05d}",
            "seq": rng.choice([i, i, None]),
            "subject_entity_id": "ent_hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]),
            "predicate": rng.choice(["present", "PRESENT!", "pre sent.", "state:near 1", "State near-2", None, "", "42", "é", "É 3", "y" * 3000]),
            "ts": rng.choice([None, float("nan")]) if rng.random() < 0.04 else rng.randrange(0, 80_000) / 4.0,
        }
        for i in range(n)
    ]
    rows += rng.sample(rows, 60)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_equal_brute_force(observations, seed):
    rows = rows_of(seed)
    by = defaultdict(list)
    for r in {r["observation_id"]: r for r in rows}.values():
        key = "".join(c for c in (r["predicate"] or "").lower() if c.isalpha())
        if r["subject_entity_id"] is not None and r["ts"] is not None and r["ts"] == r["ts"] and key:
            by[r["subject_entity_id"]].append((r["ts"], -1 if r["seq"] is None else r["seq"], r["observation_id"], key))
    want = Counter()
    for s, rs in by.items():
        run = []
        for r in [*sorted(rs), (float("inf"), 0, "", "")]:
            if run and (r[3] != run[-1][3] or r[0] - run[-1][0] > 120):
                want[s, run[0][2], run[-1][2], len(run), run[-1][0] - run[0][0]] += 1
                run = []
            run.append(r)
    found = collapse_runs(observations(rows, ("k", "g0", "key", "n", "head"))).collect()
    assert Counter((r[0], r.first_observation_id, r.last_observation_id, r.n_events, r.duration_s) for r in found) == want


def test_runs_over_many_chunks(spark, observations):
    """One run that spans every range partition stays one run."""
    rows = [{"observation_id": f"o{i:05d}", "seq": i, "subject_entity_id": "a", "predicate": "present", "ts": float(i)} for i in range(4000)]
    found = collapse_runs(observations(rows)).collect()
    assert [(r.first_observation_id, r.last_observation_id, r.n_events) for r in found] == [("o00000", "o03999", 4000)]


def test_runs_of_nothing(observations):
    assert collapse_runs(observations([])).count() == 0


def union_find(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "ring"])
def test_components_equal_union_find(spark, shape):
    rng = random.Random(7)
    name = "n{:04d}".format
    pairs = {
        "chain": [(name(i), name(i + 1)) for i in range(60)],
        "star": [(name(500), name(i)) for i in range(400)],
        "ring": [(name(i), name((i + 1) % 30)) for i in range(30)] * 2,
        "random": [(name(rng.randrange(300)), name(rng.randrange(300))) for _ in range(220)],
    }[shape]
    rng.shuffle(pairs)
    df = spark.createDataFrame([*pairs, (None, "x"), ("x", None), ("self", "self")], "a string, b string")
    want = union_find([p for p in pairs if p[0] != p[1]])
    got = connected(df).collect()
    assert len(got) == len(want) and {r.id: r.group_id for r in got} == want


def test_merge_statuses(spark, entities):
    rows = [
        ("ent_B", "merged_into:ent_a"), ("ent_c", " Merged_Into: \tENT_B\n"), ("ent_c", "active"), ("ent_d", "was merged_into:ent_a"),
        ("ent_e", "merged_into:ent_e"), ("ent_f", None), (None, "merged_into:ent_a"), ("ent_g", "merged_into:gone"), ("ent_h", "merged_into:"),
    ]
    df = entities([{"entity_id": i, "status": s} for i, s in rows])
    got = {r.entity_id: r.group_id for r in merge_groups(df).collect()}
    assert got == {"ent_a": "ent_a", "ent_b": "ent_a", "ent_c": "ent_a", "ent_g": "ent_g", "gone": "ent_g"}
    assert merge_links(df.limit(0)).count() == 0 and merge_groups(df.limit(0)).count() == 0


def brute_counts(values, max_n):
    occ, rec = Counter(), Counter()
    for v, w in values:
        t = terms(v)
        grams = Counter(tuple(t[i : i + n]) for n in range(1, max_n + 1) for i in range(len(t) - n + 1))
        for g, c in grams.items():
            occ[" ".join(g)] += c * w
            rec[" ".join(g)] += w
    return {g: (occ[g], rec[g]) for g in occ}


@given(st.lists(st.sampled_from("ab"), max_size=12))
@settings(deadline=None, max_examples=200)
def test_record_suffix_depths_count_distinct_ngrams(words):
    distinct = {tuple(words[i : i + n]) for n in range(1, 6) for i in range(len(words) - n + 1)}
    assert sum(len(s.split(" ")) - d for s, d in record_suffixes(words, 5)) == len(distinct)


@pytest.mark.parametrize("max_n", [1, 3, 32])
def test_ngrams_equal_brute_force(spark, max_n):
    rng = random.Random(max_n)
    values = [(" ".join(rng.choice(["a", "b", "ab", "é1", "long"]) for _ in range(rng.randrange(0, 9))), rng.randrange(1, 50)) for _ in range(300)]
    values += [("state:near_by", 7), ("", 3), ("?!", 2), ("A a-A", 1000)]
    df = spark.createDataFrame([*values, (None, 5)], "value string, w bigint")
    got = ngram_counts(df, max_n).collect()
    assert len(got) == len({r.ngram for r in got})
    assert {r.ngram: (r.occurrences, r.records) for r in got} == brute_counts(values, max_n)
    assert ngram_counts(df.limit(0)).count() == 0


def test_ngrams_of_long_records_are_all_counted(spark, monkeypatch):
    from memlake.llm import ngrams

    monkeypatch.setattr(ngrams, "BATCH_CHARS", 10_000)
    rng = random.Random(9)
    words = [rng.choice("abcdef") for _ in range(260)]
    values = [(" ".join(words[i : i + 200]), i + 1) for i in (0, 30, 60)] + [(" ".join(["x"] * 200), 3), ("x x", 2)]
    got = ngram_counts(spark.createDataFrame(values, "value string, w bigint")).collect()
    want = brute_counts(values, 200)
    assert len(got) == len(want) and {r.ngram: (r.occurrences, r.records) for r in got} == want and max(r.n for r in got) == 200


def test_marks(observations):
    rows = [{"observation_id": str(i), "predicate": p} for i, p in enumerate(["door open"] * 30 + ["lone"] * 4 + ["five"] * 5 + [None, "!!"])] * 2
    records = term_records(observations(rows, ("w", "value", "_id")))
    got = {r.ngram: r.mark for r in with_mark(ngram_counts(records, 1), records).collect()}
    assert got == {"door": "common", "open": "common", "lone": "rare", "five": "common"}


def test_terms_are_runs_of_letters_and_digits():
    assert terms("State:Near_2 — Ünïcode　ｆｕｌｌ") == ["state", "near", "2", "ünïcode", "ｆｕｌｌ"]
