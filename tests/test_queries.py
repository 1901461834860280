"""Every registered query against its SQL counterpart, on the small tables."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_point

FOLDER = os.environ.get("SITEOPS_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(FOLDER)):
        table = name.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


#: Those of the text pipeline have tests of their own.
OWN = sorted(n for n in entry_point.queries() if n != "pipeline" and not re.match(r"op\d+_", n))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = entry_point.queries()[name](spark, FOLDER)
    sql = entry_point.oracle_sql()[name]
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want = rows_of(columns, cursor.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    assert [(g, w) for g, w in zip(got, want) if g != w][:3] == []


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_query_has_a_counterpart():
    assert set(OWN) <= set(entry_point.oracle_sql()) <= set(entry_point.queries())
