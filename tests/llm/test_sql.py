"""Training-data queries beside their DuckDB twins."""

import compare
import pytest

from spanwright.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(spark, duck, name):
    assert compare.difference(queries.QUERIES[name](spark, compare.DATA), queries.SQL[name], duck) == ""
