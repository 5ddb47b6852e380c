"""Enough tasks for work that is heavy per byte."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the cluster has cores.

    A scan gives a task a file split, so a small table of long work would keep a few
    cores busy and leave the rest idle.  Only then is it dealt out (twice the cores, by
    turns); a table with a split a core or more is left where it is and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
