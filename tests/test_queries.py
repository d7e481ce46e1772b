"""Every registered query with SQL gives the rows of its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from check_queries import TABLES, check

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_names():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_same_as_sql(spark, con, name):
    note, _, good = check(name, entry_module.queries()[name], entry_module.oracle_sql()[name], spark, con, FOLDER)
    assert good, note


def test_entry(spark):
    assert entry_module.entry(spark).count() == 20
