"""Every registered query against its SQL, over the smallest sample."""

import pytest

import __spark_entry__ as entry
from tests.compare import check, connect

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert check(spark, con, name, entry.queries()[name], ORACLE[name], sf_dir) is None


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_statement():
    from tidewatch.plans.catalog import QUERIES

    assert set(QUERIES) <= set(ORACLE) <= set(entry.queries())
