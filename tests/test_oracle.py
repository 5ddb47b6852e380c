"""Every query that SQL can express, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import oracle_check
from memlake.plans import registry

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


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = oracle_check.canonical(registry.queries()[name](spark, str(FOLDER)).toPandas())
    want = oracle_check.canonical(con.execute(registry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want), got.merge(want, how="outer", indicator=True).query("_merge != 'both'").head()


def test_core_does_not_need_llm():
    import subprocess
    import sys

    code = (
        "import sys; sys.modules['memlake.llm'] = None\n"
        "import __spark_entry__ as e; q = e.queries()\n"
        "assert 'p3_found' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q)"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
