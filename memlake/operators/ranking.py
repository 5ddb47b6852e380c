"""Fusing, re-ranking and thinning of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60.0


def ranked(scores: DataFrame, key: str = "observation_id", score: str = "score") -> DataFrame:
    """(key, rank) from 1, best score first, ties by key.

    Lists are shortlists of fixed length (500 or 200), so one task holds them.
    """
    w = Window.orderBy(F.desc(score), key)
    return scores.select(key, F.row_number().over(w).alias("rank"))


def fuse(key: str = "observation_id", k: float = RRF_K, **lists: DataFrame) -> DataFrame:
    """(key, score, reason) of several ranked lists: sum of 1 / (k + rank); reason is the list's name or ``both``."""
    parts = [df.select(key, (1.0 / (k + F.col("rank"))).alias("score"), F.lit(n).alias("reason")) for n, df in lists.items()]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy(key).agg(
        F.sum("score").alias("score"),
        F.when(F.min("reason") == F.max("reason"), F.min("reason")).otherwise("both").alias("reason"),
    )


def rerank(fused: DataFrame, similarity: DataFrame, key: str = "observation_id", head: int = 50, boost: float = 0.5, k: float = RRF_K) -> DataFrame:
    """Boosts the ``head`` best rows by their visual rank; it never adds or removes a row."""
    top = fused.orderBy(F.desc("score"), key).limit(head).select(key)
    w = Window.orderBy(F.desc("similarity"), key)
    seen = similarity.join(top, key, "left_semi").select(key, F.row_number().over(w).alias("_r"))
    return (
        fused.join(seen, key, "left")
        .withColumn("score", F.col("score") + F.coalesce(boost / (k + F.col("_r")), F.lit(0.0)))
        .withColumn("reranked", F.col("_r").isNotNull())
        .drop("_r")
    )


def collapse_hits(hits: DataFrame, window: float = 120.0) -> DataFrame:
    """Runs of one subject's equal predicates, each at most ``window`` seconds after the one before, as one hit.

    The hit keeps the best score of its run, with the id that has it.  Runs are made
    within days, so that no task sorts all rows of a hot subject; only the first and the
    last run of each day can go on in another day and are joined across days.
    """
    key = ["entity_id", "predicate"]
    best = F.struct("score", -F.col("ts"), "observation_id", "text")
    days = hits.withColumn("_day", F.floor(F.col("ts") / 86400))
    w = Window.partitionBy(*key, "_day").orderBy("ts", "observation_id")
    new = F.when(F.col("ts") - F.lag("ts").over(w) <= window, 0).otherwise(1)
    runs = (
        days.withColumn("_new", new)
        .withColumn("_run", F.sum("_new").over(w))
        .groupBy(*key, "_day", "_run")
        .agg(
            F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"), F.max(best).alias("_best"),
            F.min("reason").alias("_least"), F.max("reason").alias("_most"),
        )
        .withColumn("_runs", F.max("_run").over(Window.partitionBy(*key, "_day")))
    )
    edge = (F.col("_run") == 1) | (F.col("_run") == F.col("_runs"))
    over = Window.partitionBy(*key).orderBy("_day", "_run")
    apart = F.when(F.col("first_seen") - F.lag("last_seen").over(over) <= window, 0).otherwise(1)
    joined = (
        runs.where(edge).withColumn("_new", apart).withColumn("_island", F.sum("_new").over(over)).groupBy(*key, "_island")
        .agg(
            F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("n"), F.max("_best").alias("_best"),
            F.min("_least").alias("_least"), F.max("_most").alias("_most"),
        )
    )
    out = [*key, "first_seen", "last_seen", "n", "_best", "_least", "_most"]
    return runs.where(~edge).select(*out).unionByName(joined.select(*out)).select(
        *key, "first_seen", "last_seen", "n", "_best.score", "_best.observation_id", "_best.text",
        F.when(F.col("_least") == F.col("_most"), F.col("_least")).when(F.col("_least").isNotNull(), "both").alias("match_reason"),
    )


def pick_spread(frames: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """(key, picked): ``k`` values spread over the order of ``ts``, both ends kept; fewer if there are no more."""
    # places are counted by day, so that a hot key's frames aren't sorted in one task
    frames = frames.withColumn("_day", F.floor(F.col("ts") / 86400))
    days = frames.groupBy(key, "_day").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    days = days.withColumn("_n", F.sum("_c").over(Window.partitionBy(key)))
    w = Window.partitionBy(key, "_day").orderBy("ts", value)
    placed = frames.withColumn("_r", F.row_number().over(w)).join(days, [key, "_day"])
    placed = placed.withColumn("_i", F.col("_before") + F.col("_r") - 1)
    if k == 1:
        wanted = F.col("_i") == 0
    else:
        step = [F.bround(F.lit(i) * (F.col("_n") - 1) / (k - 1)).cast("int") for i in range(k)]
        wanted = (F.col("_n") <= k) | F.col("_i").isin(*step)
    listed = F.array_sort(F.collect_list(F.struct("_i", value)))
    return placed.where(wanted).groupBy(key).agg(F.transform(listed, lambda x: x[value]).alias("picked"))
