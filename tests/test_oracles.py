"""Every core query against its SQL."""

import pytest
from conftest import same_rows

from touchline.plans import problems, reference, reference_sql

QUERIES = {**reference.QUERIES, **problems.QUERIES}
ORACLES = {**reference_sql.ORACLES, **problems.ORACLES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, data, duck, name):
    same_rows(QUERIES[name](spark, data), duck.execute(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
