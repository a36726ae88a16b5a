import os

import pytest

from hodograph.llm import registry

from .. import sqlcheck


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(sqlcheck.SF):
        pytest.skip("no test tables here")
    return sqlcheck.connect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, con, name):
    sqlcheck.compare(spark, con, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", ["p4_neighbours", "p7_packed", "p7_windows", "p8_found", "p8_spans", "p8_cleaned"])
def test_query_runs(spark, con, name):
    assert registry.queries()[name](spark, sqlcheck.SF).count() > 0


def test_found_columns():
    import __spark_entry__

    assert all(f"p{n}_found" in __spark_entry__.queries() for n in (1, 2, 3, 4, 5, 6, 8, 9))
