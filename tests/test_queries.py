"""Every registered query against its SQL twin on the smallest data."""

import datetime
import math
import os

import duckdb
import pytest

from gaugework.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

CHOSEN = sorted(catalog.QUERIES)

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data is not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)):
        number = float(value)
        return "nan" if math.isnan(number) else number + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=str)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA)
    got = sorted_rows(found.columns, found.collect())
    cursor = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert got == sorted_rows(names, cursor.fetchall())


def test_names_are_unique_and_paired():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
