"""Every registered query against its SQL, on the smallest tables."""

import pytest
from check import database, differences

from __spark_entry__ import entry, oracle_sql, queries
from orderstream.oracles import all_oracles
from orderstream.queries import all_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, con, name):
    got = queries()[name](spark, FOLDER).toPandas()
    assert differences(got, con.sql(oracle_sql()[name]).df()) == []


def test_entry(spark):
    assert entry(spark).columns == ["section", "rank", "name", "detail", "amount", "number"]
