"""Per-key totals when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators.dedupe import once

#: One row in so many is looked at to find heavy keys; a key with this share of them is heavy.
SAMPLE_ONE_IN, HEAVY_SHARE, SALTS = 16, 0.01, 64


def key_totals(
    observations: DataFrame,
    fields: tuple[str, ...] = ("subject_entity_id", "location_id"),
    *,
    sample_one_in: int = SAMPLE_ONE_IN,
    heavy_share: float = HEAVY_SHARE,
    salts: int = SALTS,
) -> DataFrame:
    """Count, confidence sum and first and last ``ts`` of every value of every field.

    Heavy keys are found on a sample (by hash of the id, so the same each time): at
    most ``1 / heavy_share`` keys a field, a size that doesn't grow with the data, so
    they are broadcast.  Their rows are spread over ``salts`` partial groups, all other
    rows take the ordinary shuffle, and both parts are united.  The sample only steers
    the work: a missed or needless heavy key changes no figure.

    Redelivered observations count once (by id; rows without id each count).  A null
    key gives no row; null or NaN confidences add nothing, a key with none has a null
    sum; null or NaN ``ts`` are left out of first and last.  Returns ``key_field,
    key_value, n, confidence_sum, first_ts, last_ts``; empty input gives no rows.
    """
    return _totals(observations, fields, sample_one_in, heavy_share, salts).where(F.col("key_value").isNotNull())


def _keys(rows: DataFrame, fields: tuple[str, ...], *columns) -> DataFrame:
    """One row for each field of each row: (key_field, key_value, columns)."""
    keys = F.array(
        *(F.struct(F.lit(f).alias("key_field"), F.col(f).cast("string").alias("key_value")) for f in fields)
    )
    return rows.select(F.explode(keys).alias("_key"), *columns).select(
        "_key.*", *(c for c in rows.columns if c not in fields and columns)
    )


def _totals(observations: DataFrame, fields, sample_one_in: int, heavy_share: float, salts: int) -> DataFrame:
    """As ``key_totals``, with a row for the null key too."""
    # the salt comes from the id, which the shuffle by id carries anyway: both branches below then read the same shuffle
    rows = once(observations, *fields, "confidence", "ts", keep="_salt").withColumn("_salt", F.pmod(F.xxhash64("_salt"), F.lit(salts)))
    long = _keys(
        rows,
        fields,
        "_salt",
        F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"),
        F.when(~F.isnan("ts"), F.col("ts")).alias("ts"),
    )
    sample = observations.where(F.pmod(F.xxhash64("observation_id"), F.lit(sample_one_in)) == 0)
    seen = _keys(sample, fields).groupBy("key_field", "key_value").agg(F.count(F.lit(1)).alias("seen"))
    size = seen.where(F.col("key_field") == fields[0]).agg(F.sum("seen").alias("size")).scalar()
    heavy = F.broadcast(
        seen.where(F.col("key_value").isNotNull() & (F.col("seen") >= F.greatest(size * heavy_share, F.lit(2.0))))
        .select("key_field", "key_value")
    )
    sums = (F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence_sum"))
    ends = (F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    light = long.join(heavy, ["key_field", "key_value"], "left_anti").groupBy("key_field", "key_value").agg(*sums, *ends)
    hot = (
        long.join(heavy, ["key_field", "key_value"])
        .groupBy("key_field", "key_value", "_salt")
        .agg(*sums, *ends)
        .groupBy("key_field", "key_value")
        .agg(
            F.sum("n").alias("n"),
            F.sum("confidence_sum").alias("confidence_sum"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
        )
    )
    return light.unionByName(hot)


def heavy_keys(observations: DataFrame, share: float = 0.05, fields=("subject_entity_id", "location_id")) -> DataFrame:
    """The keys that hold more than ``share`` of all observations (nulls count in the total)."""
    totals = _totals(observations, fields, SAMPLE_ONE_IN, HEAVY_SHARE, SALTS)
    size = totals.groupBy("key_field").agg(F.sum("n").alias("total"))
    return (
        totals.where(F.col("key_value").isNotNull())
        .join(F.broadcast(size), "key_field")
        .where(F.col("n") > F.col("total") * share)
        .select("key_field", "key_value")
    )
