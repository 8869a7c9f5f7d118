"""Each query with an oracle gives the rows of its SQL; the others give rows."""

import pytest
from tests.oracle import connect, spark_rows, sql_rows

from stowage.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, con, name):
    names, rows = spark_rows(QUERIES[name](spark, folder))
    if name in ORACLES:
        other, expected = sql_rows(con, ORACLES[name])
        assert names == other
        assert rows == expected
    else:
        assert names


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_registry_needs_no_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; print(len(e.queries()) > 100, len(e.oracle_sql()) > 100)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).stdout.strip() == "True True"
