"""Every registered query against its SQL; rows only where there is none."""

import pytest

from compare import connect, differences
from __spark_entry__ import entry
from lendlens.oracle import ORACLE as SQL
from lendlens.registry import QUERIES

# fitted models: their numbers are checked in test_regression and test_risk_model
WITHOUT_SQL = {
    "risk_model_cv", "risk_coefficients", "risk_model_eval",
    "risk_model_fits",
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, sf_dir, name):
    found = differences(QUERIES[name](spark, sf_dir), con, SQL[name])
    assert not found, "\n".join(found)


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 5 and rows[0]["step"] == "open→link"
