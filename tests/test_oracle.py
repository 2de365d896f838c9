"""Every registered query against its SQL counterpart, whole tables."""

import pytest

import oracle
from churnspark.plans.registry import ALL

WITH_SQL = sorted(n for n, (_, sql) in ALL.items() if sql)


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", WITH_SQL)
def test_equal(spark, sf, con, name):
    run, sql = ALL[name]
    assert oracle.compare(run(spark, sf), con, sql) == []


@pytest.mark.parametrize("name", sorted(set(ALL) - set(WITH_SQL)))
def test_runs(spark, sf, name):
    assert ALL[name][0](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as registry

    assert registry.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries())
