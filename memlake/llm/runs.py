"""Repeated consecutive events: each run becomes one event with count and duration.

Range-sorted chunks encode their runs locally, then a prefix merge joins compatible
last and first runs across chunk borders (``memlake.operators.segments``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.operators.segments import segment


def letters(predicate: Column) -> Column:
    """The letters of a predicate in order, lower case: what near-identical ones share."""
    return F.regexp_replace(F.lower(predicate), r"\P{L}+", "")


def collapse_runs(observations: DataFrame, gap_seconds: float = 120.0) -> DataFrame:
    """One row for every longest run of near-identical events of a subject.

    A run goes on while the next event of the subject in (ts, seq) order has the same
    letters in ``predicate`` and comes at most ``gap_seconds`` later.  Rows without
    subject, ``ts`` (null or NaN) or any letter take no part and don't break a run;
    redelivered rows count once; equal times are ordered by ``seq``, then id.  Lone
    events are runs of one.  Empty input gives no rows; other columns are ignored.
    """
    found = segment(observations, ["subject_entity_id"], gap_seconds, key=letters(F.col("predicate")), name="runs")
    return found.select(
        "subject_entity_id",
        F.col("key").alias("predicate_letters"),
        F.col("first_id").alias("first_observation_id"),
        F.col("last_id").alias("last_observation_id"),
        F.col("first_ts").alias("start_ts"),
        F.col("last_ts").alias("end_ts"),
        (F.col("last_ts") - F.col("first_ts")).alias("duration_s"),
        F.col("n").alias("n_events"),
    )
