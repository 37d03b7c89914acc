"""Every registered query against its SQL twin in another engine."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from telemill.plans.registry import all_queries
from tests.compare import differences, oracle_connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF)


def test_every_query_has_sql():
    assert set(all_queries()) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_equals_sql(spark, connection, name):
    assert differences(queries()[name](spark, SF), connection, oracle_sql()[name]) is None


def test_entry(spark):
    assert entry(spark).count() > 0
