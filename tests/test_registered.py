"""Registered queries against their SQL on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as tool
from cairn.plans import registry

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

QUERIES, SQL = registry.runnable(), registry.sql_texts()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    number = float(value)
    return "nan" if math.isnan(number) else round(number, 6)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, df.collect())
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert got == table(names, cursor.fetchall())
    assert got, "the query should not be empty on the test tables"


def test_entry_runs(spark):
    assert tool.entry(spark).columns == ["artifact_id", "device_id", "extension", "relative_path", "filename", "size_bytes", "mtime_ns"]
