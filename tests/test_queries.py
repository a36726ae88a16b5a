import os
import subprocess
import sys

import pytest

from hodograph import catalog

from . import sqlcheck

# Searches and sweeps of many small jobs; their operators have tests of their own.
SLOW = {"e11_grid", "e17_stuck_roots", "e22_dissection", "f16_throughput", "f18_deviation", "f6_levels", "g18_summary", "g9_sweep", "q14_candidate_front"}


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(sqlcheck.SF):
        pytest.skip("no test tables here")
    return sqlcheck.connect()


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_query_matches_its_sql(spark, con, name):
    sqlcheck.compare(spark, con, catalog.queries()[name], catalog.oracle_sql()[name])


def test_every_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_works_without_the_training_data_part(tmp_path):
    """A copy without that folder still imports and registers the core queries."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/hodograph", tmp_path / "hodograph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k in q for k in ('p1_found', 'p9_found')); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
