"""Every registered query against the SQL that defines it."""

import pytest

import __spark_entry__ as entry
from tools.compare import compare, oracle


@pytest.fixture(scope="module")
def con(folder):
    return oracle(folder)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_report(spark, folder, con, name):
    outcome, rows, _ = compare(spark, con, folder, name)
    assert outcome in ("ok", "no SQL") and rows > 0, outcome


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
