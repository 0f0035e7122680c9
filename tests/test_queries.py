"""Every registered query of the core runs, and equals its SQL where it has one."""

import pytest

from factloom.plans import dealt, reports
from tests.oracle import check

QUERIES = reports.QUERIES | dealt.QUERIES
SQL = reports.SQL | dealt.SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in SQL:
        check(df, SQL[name], data)
    else:
        assert df.columns and df.count() > 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
