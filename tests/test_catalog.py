"""Every registered query agrees with its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from inkgate.catalog import ORACLES, QUERIES
from oracle import connect, spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def views():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, views, name):
    columns, got = spark_rows(QUERIES[name](spark, FOLDER))
    want_columns, want = sql_rows(views, ORACLES[name])
    assert columns == want_columns
    assert sum(got.values()) == sum(want.values())
    assert list((got - want).items())[:2] == []
