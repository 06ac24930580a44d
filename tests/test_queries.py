"""Every named query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from cohortmill.plans.registry import ORACLES, QUERIES
from tests.compare import check, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    text, _, good = check(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert good, text


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "survival" in df.columns


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES) <= set(entry_points.queries())
