"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, database

import __spark_entry__ as entry
from wiretally.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    outcome = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert outcome.startswith("ok"), outcome
    assert "TYPES" not in outcome, outcome


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "severity", "n"]


def test_all_queries_have_sql():
    assert ORACLES.keys() == QUERIES.keys()
