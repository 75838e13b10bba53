"""Every registered query: equal to its SQL, or valid without one."""

from __future__ import annotations

import pytest
from compare import differences

from registry import ORACLE, QUERIES

NO_SQL = sorted(set(QUERIES) - set(ORACLE))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert differences(got, con.execute(ORACLE[name]).df()) is None


@pytest.mark.parametrize("name", NO_SQL)
def test_runs_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
