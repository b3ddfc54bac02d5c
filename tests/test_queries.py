"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from weftlex import plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(name, spark, sf_dir, same_as_sql):
    same_as_sql(plans.QUERIES[name](spark, sf_dir), plans.SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_runs(name, spark, sf_dir):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["text", "frequency", "n", "rank"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
