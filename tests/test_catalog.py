"""Every query of the reference's operators against its SQL."""

from __future__ import annotations

import pytest

from docloom import registry
from helpers import by_spark, by_sql

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    got = by_spark(QUERIES[name](spark, sf))
    assert got == by_sql(SQL[name], sf)


def test_entry_runs_without_llm(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_entry_is_imported_without_a_session():
    """The driver imports the entry before it makes a session."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; print(len(e.queries()) - len(e.oracle_sql()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout) >= 0
