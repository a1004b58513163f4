"""Every query that has SQL gives what DuckDB gives; the smoke query runs."""

import datetime as dt
import decimal
import math
import os

import pytest

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, dt.datetime) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


def names():
    from docmill import queries

    return sorted(queries.SQL)


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, duck, name):
    from docmill import queries

    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(queries.SQL[name])
    have = [d[0] for d in cursor.description]
    assert sorted(have) == columns
    assert got == sorted((tuple(norm(r[have.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
