"""Every query with SQL gives the rows that DuckDB gives."""
from pathlib import Path

import duckdb
import pytest

from docweave.plans.catalogue import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"create view {p.stem} as from '{p}'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    if name in ORACLE:
        want = con.sql(ORACLE[name])
        assert sorted(want.columns) == cols
        assert got == sorted(repr(r) for r in want.select(",".join(f'"{c}"' for c in cols)).fetchall())
    else:
        assert got


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
