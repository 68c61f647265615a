from __future__ import annotations

import pytest
from tests.compare import same

from tracewell.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.oracle_sql()[name])
