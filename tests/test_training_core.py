"""Sessions, heavy keys and trailing totals against brute force, on hostile rows."""

import math
import random
from collections import defaultdict
from datetime import date, timedelta

import pytest

from memlake.operators.rolling import trailing_totals
from memlake.operators.segments import sessions
from memlake.operators.skew import heavy_keys, key_totals

CLASHING = ("k", "g0", "id", "n", "head", "tail", "chunk", "salt", "key_value", "day", "_id")


def hostile(seed, n=1500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.4
        rows.append(
            {
                "observation_id": f"obs_{i:05d}",
                "seq": rng.choice([i, i, None]),
                "subject_entity_id": "ent_hot" if hot else rng.choice(["ent_a", "ent_b", "scene:x", None, ""]),
                "predicate": rng.choice(["present", "Present!", "near", None, "", "é 1", "x" * 5000]),
                "location_id": rng.choice(["loc_1", "loc_1", "loc_1", "loc_2", None]),
                "camera_id": rng.choice(["cam_1", "cam_2", None]),
                "ts": rng.choice([None, float("nan")]) if rng.random() < 0.05 else rng.randrange(0, 400_000) / 4.0,
                "confidence": rng.choice([None, float("nan"), -1.0, 1.5, 0.25, 0.5, 0.75, 1.0]),
            }
        )
    rows += rng.sample(rows, n // 20)  # delivered again
    rng.shuffle(rows)
    return rows


def usable(rows, *columns):
    once = {r["observation_id"]: r for r in rows}
    return [r for r in once.values() if all(r[c] is not None and r[c] == r[c] for c in columns)]


def in_order(rows):
    return sorted(rows, key=lambda r: (r["ts"], -1 if r["seq"] is None else r["seq"], r["observation_id"]))


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_equal_brute_force(observations, seed):
    rows = hostile(seed)
    groups = defaultdict(list)
    for r in in_order(usable(rows, "subject_entity_id", "camera_id", "ts")):
        groups[r["subject_entity_id"], r["camera_id"]].append(r)
    want = set()
    for (s, c), rs in groups.items():
        run = [rs[0]]
        for r in rs[1:]:
            if r["ts"] - run[-1]["ts"] > 300:
                want.add((s, c, run[0]["observation_id"], run[-1]["observation_id"], len(run)))
                run = []
            run.append(r)
        want.add((s, c, run[0]["observation_id"], run[-1]["observation_id"], len(run)))
    found = sessions(observations(rows, CLASHING), 300)
    got = [(r[0], r[1], r[2], r[3], r.n_events) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_sessions_of_nothing(observations):
    assert sessions(observations([])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_key_totals_equal_brute_force(observations, seed):
    rows = hostile(seed)
    want = {}
    for field in ("subject_entity_id", "location_id"):
        by = defaultdict(list)
        for r in usable(rows):
            if r[field] is not None:
                by[r[field]].append(r)
        for k, rs in by.items():
            conf = [r["confidence"] for r in rs if r["confidence"] is not None and r["confidence"] == r["confidence"]]
            ts = [r["ts"] for r in rs if r["ts"] is not None and r["ts"] == r["ts"]]
            want[field, k] = (len(rs), round(sum(conf), 6) if conf else None, min(ts, default=None), max(ts, default=None))
    df = observations(rows, CLASHING)
    for share in (0.01, 0.3):  # which keys are heavy changes no figure
        got = {
            (r.key_field, r.key_value): (r.n, None if r.confidence_sum is None else round(r.confidence_sum, 6), r.first_ts, r.last_ts)
            for r in key_totals(df, sample_one_in=2, heavy_share=share, salts=3).collect()
        }
        assert got == want
    total = len(usable(rows))
    assert {tuple(r) for r in heavy_keys(df).collect()} == {k for k, v in want.items() if v[0] > 0.05 * total}


def test_key_totals_of_nothing(observations):
    assert key_totals(observations([])).count() == 0
    assert heavy_keys(observations([])).count() == 0


def test_rows_without_id_each_count(observations):
    rows = [{"subject_entity_id": "ent_a", "location_id": None, "ts": 1.0}] * 3
    assert {r.key_value: r.n for r in key_totals(observations(rows)).collect()} == {"ent_a": 3}


@pytest.mark.parametrize("seed", [3])
def test_trailing_totals_equal_brute_force(observations, seed):
    rows = hostile(seed)
    for r in rows:
        if r["ts"] is not None:
            r["ts"] *= 80  # over three months
    days = defaultdict(lambda: defaultdict(list))
    for r in usable(rows, "subject_entity_id", "ts"):
        days[r["subject_entity_id"]][math.floor(r["ts"] / 86400)].append(r["confidence"])
    want = {}
    for s, by in days.items():
        for d in range(min(by), max(by) + 1):
            cell = []
            for p in (7, 30):
                values = [c for e in range(d - p + 1, d + 1) for c in by.get(e, ())]
                good = [c for c in values if c is not None and c == c and 0 <= c <= 1]
                cell += [len(values), round(sum(good), 6), sum(good) / len(good) if good else None]
            want[s, date(1970, 1, 1) + timedelta(days=d)] = cell
    got = {(r[0], r[1]): list(r)[2:] for r in trailing_totals(observations(rows, CLASHING)).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, nan_ok=False)


def test_trailing_totals_of_nothing(observations):
    assert trailing_totals(observations([])).count() == 0
