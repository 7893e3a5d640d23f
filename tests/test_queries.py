"""Every query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from harvestry.catalog import load_all
from tools.check_queries import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
ENTRIES = load_all()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(spark, duck, name):
    entry = ENTRIES[name]
    df = entry(spark, FOLDER)
    got = rows_of(df.columns, df.collect())
    if entry.sql is not None:
        cur = duck.execute(entry.sql)
        assert got == rows_of([d[0] for d in cur.description], cur.fetchall())
