"""Every SQL-checkable catalog query equals its DuckDB oracle (smallest scale)."""

import os

import pytest

from oracle_compare import compare

import __spark_entry__ as E
from echoline.plans.catalog import QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SLOW = {"gbt_scores", "rf_importance", "stacked_scores", "noise_te"}


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) & set(QUERIES) - SLOW))
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF, [name], verbose=False)[name]
    assert res is True, res


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "user_id" in df.columns


def test_every_query_has_oracle_or_is_rows_only():
    rows_only = set(QUERIES) - set(E.oracle_sql())
    assert rows_only <= {"gbt_scores", "rf_importance", "stacked_scores", "continued_scores"}
