"""Every registered query against its SQL, and the contract's entry point."""

import os

import pytest
from oracle import duck_rows, spark_rows

from textloom.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, name):
    assert spark_rows(catalogue.queries()[name](spark, DATA)) == duck_rows(DATA, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["k", "n_rows", "n_docs"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
