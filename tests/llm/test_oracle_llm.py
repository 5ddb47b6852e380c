"""The llm queries that SQL can express, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import oracle_check
from memlake.llm import queries

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not FOLDER.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, con, name):
    got = oracle_check.canonical(queries.QUERIES[name](spark, str(FOLDER)).toPandas())
    want = oracle_check.canonical(con.execute(queries.ORACLE[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def test_every_problem_has_its_query():
    found = set(queries.QUERIES)
    assert {"p1_found", "p2_found", "p4_found", "p7_found", "p8_ids", "p9_found", "p10_found"} <= found
