"""Every registered core query runs; those with SQL equal it."""

import pytest

from leafmill.plans import registry

QUERIES, SQL = registry.core_queries(), registry.core_sql()


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, con, sf):
    from oracle import compare

    assert compare(spark, con, QUERIES[name], SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['leafmill.llm'] = None; import __spark_entry__ as e; assert e.llm is None and 'p2_found' in e.queries() and 'p1_found' not in e.queries()"
    import os

    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0
