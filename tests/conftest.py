import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from memlake.session import local_session  # noqa: E402

OBS = (
    "observation_id string, seq bigint, subject_entity_id string, predicate string, object_entity_id string,"
    " location_id string, ts double, confidence double, source_ref string, origin string, camera_id string,"
    " user_id string, status string, assignee string, description_id string, text string, received_at timestamp"
)
NAMES = [c.split()[0] for c in OBS.split(", ")]


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cpus=4, memory="4g")


@pytest.fixture(scope="session")
def observations(spark):
    """observations(rows, extra=...): a table from dicts; what a row leaves out is null."""

    def make(rows, extra=()):
        df = spark.createDataFrame([tuple(r.get(c) for c in NAMES) for r in rows], OBS)
        for name in extra:  # columns that clash with those operators use inside
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def entities(spark):
    def make(rows):
        cols = ["entity_id", "type", "label", "created_at", "status"]
        return spark.createDataFrame(
            [tuple(r.get(c) for c in cols) for r in rows], "entity_id string, type string, label string, created_at double, status string"
        )

    return make
