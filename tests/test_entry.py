"""Every registered query runs and equals its SQL over the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks.oracle import SQL
from checks.queries import QUERIES

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables to check against")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    yield con
    con.close()


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    def value(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else v
    return [names[i] for i in order], sorted(
        (tuple(value(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(entry.oracle_sql()[name])
    want = table([d[0] for d in found.description], found.fetchall())
    assert got == want
    kinds = [{type(v) for v in column if v is not None} for column in zip(*got[1])]
    assert kinds == [{type(v) for v in column if v is not None} for column in zip(*want[1])]


def test_the_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "id" and df.count() > 0
