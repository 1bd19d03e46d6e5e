"""Every registered query against its SQL, over whole tables."""

import duckdb
import pytest
from tables import SF_DIR, TABLES

import __spark_entry__ as driver
from changetrail.plans.oracle import ORACLE
from changetrail.plans.queries import REGISTRY


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in records)


def test_every_query_has_an_oracle():
    assert set(REGISTRY) == set(ORACLE)
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, duck, name):
    result = driver.queries()[name](spark, SF_DIR)
    expected = duck.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert sorted(result.columns) == sorted(columns)
    found = rows_of(result.columns, result.collect())
    assert found == rows_of(columns, expected.fetchall())
    assert found, "a query that finds nothing checks nothing"


def test_entry_gives_the_flagship_page(spark):
    page = driver.entry(spark)
    assert page.count() == 30
    assert page.columns[-1] == "username"
