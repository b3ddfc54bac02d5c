"""The queries of these operators against their SQL, and the registry."""

from __future__ import annotations

import re

import pytest

from weftlex.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, spark, sf_dir, same_as_sql):
    same_as_sql(queries.QUERIES[name](spark, sf_dir), queries.SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, len(queries.QUERIES) + 1))
