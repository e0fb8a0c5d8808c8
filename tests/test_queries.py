"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value if isinstance(value, (bool, int, str, decimal.Decimal, type(None))) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    typed = [tuple((type(plain(r[i])).__name__, plain(r[i])) for i in order) for r in rows]
    return sorted(columns), sorted(typed, key=repr)


def test_every_query_has_sql():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 100


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(name, spark, duck):
    df = queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name not in oracle_sql():
        assert got[1]
        return
    result = duck.execute(oracle_sql()[name])
    assert got == rows_of([c[0] for c in result.description], result.fetchall())
