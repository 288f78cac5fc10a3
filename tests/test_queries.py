"""Every query with an SQL counterpart gives the same rows on the smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tools.check import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, db, name):
    columns, rows = spark_rows(entry.queries()[name](spark, SF))
    assert rows and Counter(rows) == Counter(sql_rows(db, ORACLE[name], columns))


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())
