"""One row for each observation, however often it was delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(observations: DataFrame, *columns: str, key: str = "observation_id", keep: str | None = None) -> DataFrame:
    """The named columns of every observation once, by ``key`` (and the key itself, under the name ``keep``).

    Deliveries repeat the row, so any of them serves; the shuffle carries only the
    named columns.  Rows without a key can't be told apart and each counts.
    """
    rows = observations.select(F.col(key).alias("_id"), *(F.col(f"`{c}`") for c in columns))
    # rows without a key get one that no key has, so that they stay and spread over all tasks
    tag = F.when(F.col("_id").isNull(), F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string")))
    rows = rows.withColumn("_id", F.coalesce("_id", tag)).dropDuplicates(["_id"])
    return rows.withColumnRenamed("_id", keep) if keep else rows.drop("_id")
