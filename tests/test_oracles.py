"""Every telemetry query against its SQL."""

import pytest
from compare import duck_rows, spark_rows
from conftest import DATA

from kinetrace.plans import oracle, queries

QUERIES, ORACLES = queries.queries(), oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names, want = duck_rows(duck, ORACLES[name])
    assert sorted(df.columns) == names
    assert spark_rows(df) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
