"""Every registered query of the engine against its SQL in DuckDB, on the small tables."""

import glob
import os

import duckdb
import pytest

from cellarium import catalogue, catalogue_tools  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def shown(rows):
    return sorted(repr(tuple(None if v is None else round(v, 6) if isinstance(v, float) else str(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_like_sql(spark, tables, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = tables.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert shown(df.select(*columns).collect()) == shown([[r[i] for i in order] for r in want.fetchall()])


def test_queries_without_sql(spark):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL):
        assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
