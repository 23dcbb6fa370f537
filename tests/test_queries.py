"""Every query with SQL, on the smallest tables, against DuckDB."""

import math
import os

import duckdb
import pytest

from reelmill import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return connection


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 8) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, sf_dir, sql, name):
    df = plans.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    relation = sql.sql(plans.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 21
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(entry.__file__)
