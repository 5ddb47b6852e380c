"""Totals over trailing periods for every entity and day, days without activity included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.dedupe import once


def trailing_totals(
    observations: DataFrame, periods: tuple[int, ...] = (7, 30), low: float = 0.0, high: float = 1.0
) -> DataFrame:
    """Observations, confidence sum and average over the last ``periods`` days, for each subject and UTC day.

    Rows are summed to (subject, day) first, so that a hot subject is no larger than
    its number of days.  Each daily total is then exploded onto every output date that
    it influences (at most the longest period), and the calendar from the subject's
    first to its last day joins in as zeros: the first day's row also covers the dates
    beyond its influence.  One shuffle by subject serves calendar, explosion and sums.

    Confidences outside ``low``..``high``, null or NaN ones are left out of sum and
    average (the observation still counts); an average over none is null and the sum 0.
    Rows without subject or ``ts`` (null or NaN) take no part; redelivered rows count
    once.  Returns ``subject_entity_id, day, n_<p>d, confidence_sum_<p>d,
    confidence_avg_<p>d`` for each period.
    """
    longest = max(periods)
    rows = once(observations.where(F.col("ts").isNotNull() & ~F.isnan("ts")), "subject_entity_id", "ts", "confidence")
    good = F.col("confidence").between(low, high)
    daily = (
        rows.where(F.col("subject_entity_id").isNotNull())
        .select(
            "subject_entity_id",
            F.floor(F.col("ts") / 86400).cast("int").alias("d"),
            F.when(good, F.col("confidence")).alias("c"),
        )
        .groupBy("subject_entity_id", "d")
        .agg(F.count(F.lit(1)).alias("n"), F.count("c").alias("nc"), F.sum("c").alias("sc"))
        .repartition("subject_entity_id")
    )
    w = Window.partitionBy("subject_entity_id")
    spread = (
        daily.withColumn("first", F.min("d").over(w))
        .withColumn("last", F.max("d").over(w))
        .select(
            "subject_entity_id",
            "d",
            "n",
            "nc",
            "sc",
            F.explode(
                F.sequence(
                    "d",
                    F.when(F.col("d") == F.col("first"), F.col("last")).otherwise(
                        F.least(F.col("d") + (longest - 1), F.col("last"))
                    ),
                )
            ).alias("day"),
        )
    )
    aggs = []
    for p in periods:
        within = F.col("day") - F.col("d") < p
        aggs += [
            F.sum(F.when(within, F.col("n")).otherwise(0)).alias(f"n_{p}d"),
            F.sum(F.when(within, F.col("nc")).otherwise(0)).alias(f"_nc_{p}d"),
            F.coalesce(F.sum(F.when(within, F.col("sc"))), F.lit(0.0)).alias(f"confidence_sum_{p}d"),
        ]
    summed = spread.groupBy("subject_entity_id", "day").agg(*aggs)
    out = ["subject_entity_id", F.date_from_unix_date("day").alias("day")]
    for p in periods:
        total, some = F.col(f"confidence_sum_{p}d"), F.col(f"_nc_{p}d")
        out += [
            F.col(f"n_{p}d"),
            F.round(total, 6).alias(f"confidence_sum_{p}d"),
            F.when(some > 0, F.round(total, 6) / some).alias(f"confidence_avg_{p}d"),
        ]
    return summed.select(*out)
