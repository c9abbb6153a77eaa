"""Every catalogue query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from boxlake.plans import catalog, files, rules  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(table, columns):
    said = lambda v: "null" if v is None or v != v else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(map(said, r)) for r in table[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, db, name):
    mine, theirs = catalog.QUERIES[name](spark, SF).toPandas(), db.execute(catalog.ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine, sorted(mine.columns)) == rows(theirs, sorted(mine.columns))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
