"""Every registered query against its SQL twin, on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver

SF_DIR = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="driver tables absent")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def counted(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return Counter(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_equals_sql(spark, db, name):
    found = driver.queries()[name](spark, str(SF_DIR))
    cursor = db.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert counted(found.columns, found.collect()) == counted(columns, cursor.fetchall())


def test_entry_gives_rows(spark):
    assert driver.entry(spark).count() > 0
