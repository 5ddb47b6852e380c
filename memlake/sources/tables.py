"""Parquet table source with additive schema evolution.

``load`` reads only what the table holds, gives every canonical column that is
missing as null and leaves extra columns out, so that operators can rely on the
canonical names whatever else a table carries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.schema import DDL, schema


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder`` in its canonical columns (others as they are)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return conform(df, name) if name in DDL else df


def conform(df: DataFrame, name: str) -> DataFrame:
    """Canonical columns only, in order; a missing one is null."""
    have = set(df.columns)
    return df.select(
        *(
            F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema(name).fields
        )
    )
