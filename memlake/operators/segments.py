"""Ordered segmentation at any skew: sessions and runs over a range-sorted stream.

Rows are range-partitioned and sorted by (group, ts, seq, id), so one group may
span many partitions: a hot group costs no more per task than any other range.
Every partition is scanned once with constant memory (one Arrow batch and the
open segment) and yields its segments as summaries.  Summaries form a monoid:
the last segment of one chunk and the first of the next join when they are
compatible.  Only those edge summaries (two a partition at most) take part in the
prefix merge across chunk borders; all others are final as they are.

Redelivered rows sort next to each other (same group, ts, seq and id), so they are
dropped in the scan and no shuffle by id is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.scratch import materialize

_SUMMARY = "first_id string, last_id string, first_ts double, last_ts double, n bigint"


def _scan(groups: int, gap: float, keyed: bool):
    """The chunk encoder: (g0.., [k], ts, seq, id) sorted -> segment summaries with edge marks."""
    names = [f"g{i}" for i in range(groups)] + ["k"] * keyed

    def table(cols: dict, head: np.ndarray, tail: np.ndarray, chunk: int) -> pa.RecordBatch:
        n = len(head)
        arrays = [pa.array(np.full(n, chunk, np.int32)), pa.array(head), pa.array(tail)]
        arrays += [cols[x] for x in names]
        arrays += [cols["first_id"], cols["last_id"], cols["first_ts"], cols["last_ts"], cols["n"]]
        return pa.RecordBatch.from_arrays(
            arrays, ["chunk", "head", "tail", *names, "first_id", "last_id", "first_ts", "last_ts", "n"]
        )

    def of(open_: dict) -> dict:
        types = {"first_ts": pa.float64(), "last_ts": pa.float64(), "n": pa.int64()}
        return {c: pa.array([v], types.get(c, pa.string())) for c, v in open_.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        open_, emitted = None, False
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("id")
            fresh = np.ones(b.num_rows, bool)
            if b.num_rows > 1:
                fresh[1:] = pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
            if open_ is not None:
                fresh[0] = ids[0].as_py() != open_["last_id"]
            if not fresh.all():
                b = b.filter(pa.array(fresh))
                if not b.num_rows:
                    continue
                ids = b.column("id")
            rows, ts = b.num_rows, b.column("ts").to_numpy()
            cut = np.ones(rows, bool)
            cut[1:] = np.diff(ts) > gap
            for x in names if rows > 1 else ():
                c = b.column(x)
                cut[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            joins = open_ is not None and (
                ts[0] - open_["last_ts"] <= gap and all(b.column(x)[0].as_py() == open_[x] for x in names)
            )
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], rows) - 1
            count = ends - starts + 1
            if open_ is not None and not joins:
                yield table(of(open_), np.array([not emitted]), np.array([False]), chunk)
                emitted, open_ = True, None
            head = {x: b.column(x)[int(starts[-1])].as_py() for x in names}
            last = head | {
                "first_id": ids[int(starts[-1])].as_py(),
                "last_id": ids[rows - 1].as_py(),
                "first_ts": float(ts[starts[-1]]),
                "last_ts": float(ts[-1]),
                "n": int(count[-1]),
            }
            if len(starts) == 1 and joins:
                open_ = last | {"first_id": open_["first_id"], "first_ts": open_["first_ts"], "n": open_["n"] + last["n"]}
                continue
            if len(starts) > 1:
                s, e, n = starts[:-1], ends[:-1], count[:-1].astype(np.int64)
                first_id, first_ts = ids.take(pa.array(s)), ts[s].copy()
                if joins:
                    n[0] += open_["n"]
                    first_ts[0] = open_["first_ts"]
                    first_id = pa.concat_arrays([pa.array([open_["first_id"]], first_id.type), first_id[1:]])
                cols = {x: b.column(x).take(pa.array(s)) for x in names} | {
                    "first_id": first_id,
                    "last_id": ids.take(pa.array(e)),
                    "first_ts": pa.array(first_ts),
                    "last_ts": pa.array(ts[e]),
                    "n": pa.array(n),
                }
                mark = np.zeros(len(s), bool)
                mark[0] = not emitted
                yield table(cols, mark, np.zeros(len(s), bool), chunk)
                emitted = True
            open_ = last
        if open_ is not None:
            yield table(of(open_), np.array([not emitted]), np.array([True]), chunk)

    return run


def segment(
    df: DataFrame,
    groups: list[str],
    gap_seconds: float,
    *,
    key=None,
    ts: str = "ts",
    seq: str = "seq",
    row_id: str = "observation_id",
    name: str = "segments",
) -> DataFrame:
    """Longest stretches of rows of one group, each at most ``gap_seconds`` after the one before.

    With ``key`` (a Column giving a string) the rows of a stretch must also have the
    same key.  Rows where a group, ``ts``, ``row_id`` or the key is null (or the key
    is empty, or ``ts`` is NaN) take no part and don't break a stretch; a null ``seq``
    sorts first; equal ``ts`` are ordered by ``seq``, then by id.  An id delivered
    more than once counts once.  An empty table gives no rows; columns other than the
    named ones are ignored.  Returns ``groups, [key], first_id, last_id, first_ts,
    last_ts, n``.
    """
    cols = [F.col(f"`{g}`").cast("string").alias(f"g{i}") for i, g in enumerate(groups)]
    if key is not None:
        cols.append(key.alias("k"))
    rows = df.select(
        *cols,
        F.col(f"`{ts}`").cast("double").alias("ts"),
        F.col(f"`{seq}`").cast("bigint").alias("seq"),
        F.col(f"`{row_id}`").cast("string").alias("id"),
    )
    rows = rows.dropna(subset=[c for c in rows.columns if c != "seq"]).where(~F.isnan("ts"))
    if key is not None:
        rows = rows.where(F.col("k") != "")
    order = [f"g{i}" for i in range(len(groups))] + ["ts", "seq"]
    by = [f"g{i}" for i in range(len(groups))]
    names = by + (["k"] if key is not None else [])
    encoded = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order, "id")
        .mapInArrow(
            _scan(len(groups), float(gap_seconds), key is not None),
            "chunk int, head boolean, tail boolean, " + ", ".join(f"{x} string" for x in names) + ", " + _SUMMARY,
        )
    )
    chunks = materialize(encoded, name)
    summary = ["first_id", "last_id", "first_ts", "last_ts", "n"]
    whole = chunks.where(~F.col("head") & ~F.col("tail")).select(*names, *summary)
    edges = chunks.where(F.col("head") | F.col("tail")).withColumn(
        "at", F.struct("chunk", (~F.col("head")).cast("int").alias("o"))
    )
    w = Window.partitionBy(*by).orderBy("at")
    joins = (F.lag("chunk").over(w) < F.col("chunk")) & (F.col("first_ts") - F.lag("last_ts").over(w) <= gap_seconds)
    if key is not None:
        joins = joins & (F.lag("k").over(w) == F.col("k"))
    merged = (
        edges.withColumn("new", F.when(joins, 0).otherwise(1))
        .withColumn("island", F.sum("new").over(w))
        .groupBy(*by, "island")
        .agg(
            *([F.first("k").alias("k")] if key is not None else []),
            F.min_by("first_id", "at").alias("first_id"),
            F.max_by("last_id", "at").alias("last_id"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            F.sum("n").alias("n"),
        )
        .select(*names, *summary)
    )
    out = whole.unionByName(merged)
    return out.select(
        *(F.col(f"g{i}").alias(g) for i, g in enumerate(groups)),
        *([F.col("k").alias("key")] if key is not None else []),
        *summary,
    )


def sessions(observations: DataFrame, gap_seconds: float = 1800.0) -> DataFrame:
    """Visits: the observations of one subject at one camera parted by more than ``gap_seconds``.

    Secondary sort by (subject, camera, ts, seq), then one linear scan a partition.
    Null handling, ties and repeats: see ``segment``.
    """
    found = segment(observations, ["subject_entity_id", "camera_id"], gap_seconds, name="sessions")
    return found.select(
        "subject_entity_id",
        "camera_id",
        F.col("first_id").alias("first_observation_id"),
        F.col("last_id").alias("last_observation_id"),
        F.col("first_ts").alias("start_ts"),
        F.col("last_ts").alias("end_ts"),
        (F.col("last_ts") - F.col("first_ts")).alias("duration_s"),
        F.col("n").alias("n_events"),
    )
