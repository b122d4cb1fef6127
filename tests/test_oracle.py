"""Every registered query against its DuckDB oracle, at the smallest scale."""

import pytest

import __spark_entry__ as contract
import check
from casegrid.queries import QUERIES

SF = "/root/testdata/sf0.001"
WITHOUT_SQL = {"csv_to_fhir"}


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    outcome, count = check.compare(spark, con, name, SF)
    assert outcome == ("rows only" if name in WITHOUT_SQL else "ok")
    assert count > 0


def test_entry(spark):
    assert contract.entry(spark).columns[:3] == ["condition_code", "condition_display", "h3"]


def test_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) & set(QUERIES) == set(QUERIES) - WITHOUT_SQL
    assert set(contract.oracle_sql()) <= set(contract.queries())
