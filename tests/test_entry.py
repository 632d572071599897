import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from assayer.plans import bridge, made, made_sql, oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted(str([float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in r]) for r in df.values.tolist())


QUERIES, SQL = bridge.queries() | made.queries(), oracle.SQL | made_sql.SQL


def test_all_but_one_have_sql():
    # its draws come from one seeded generator; tests/test_runs.py holds it against plain Python
    assert set(QUERIES) - set(SQL) == {"bootstrap_seeded"} and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, tables, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = tables.execute(SQL[name]).df()
    assert len(want) > 0
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
