"""Every registered query against its SQL on another engine, over whole tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as driver
from crewledger.plans import catalogue
from tests.compare import connect, differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# The corpus operators have tests of their own.
QUERIES = catalogue.queries()
SQL = {name: sql for name, sql in driver.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(name, spark, connection):
    assert differences(QUERIES[name], SQL[name], spark, connection, FOLDER) is None


def test_comparison_notices_a_difference(spark, connection):
    wrong = SQL["top_clients"].replace("sum(Amount_Paid)", "sum(Amount_Paid) + 1")
    assert differences(QUERIES["top_clients"], wrong, spark, connection, FOLDER) is not None
    fewer = SQL["clients_list"] + " WHERE Client_ID > 0"
    assert "rows against" in differences(QUERIES["clients_list"], fewer, spark, connection, FOLDER)


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert len(rows) == 10
    collected = [row["Total_Collected"] for row in rows]
    assert collected == sorted(collected, reverse=True)
