"""Intermediate tables in the folder that all executors share.

A cluster names that folder in ``spark.checkpoint.dir``; only where the setting is
missing (tests, local runs) a temporary folder is made and set.  Tables written
here cut the lineage and survive the loss of an executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a temporary one in local mode."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_SETTING} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="memlake-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table."""
    _made[:] = [m for m in _made if m[1] != path]
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; what is written there goes when the process ends."""
    path = f"{shared_dir(spark)}/memlake-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table that was written."""
    return materialized(df, name)[0]


def materialized(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``materialize``, with the path, so that a loop can drop what it no longer reads."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@atexit.register
def _clean() -> None:
    for spark, path in list(_made):
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
