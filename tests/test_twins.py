"""Every query beside its DuckDB twin."""

import compare
import pytest

from spanwright import catalog

EMPTY: set[str] = set()
SLOW = {"m2_fit_predict"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_twin(spark, duck, name):
    df = catalog.QUERIES[name](spark, compare.DATA)
    if name in catalog.SQL:
        assert compare.difference(df, catalog.SQL[name], duck) == ("no rows" if name in EMPTY else "")
    elif name not in SLOW:
        assert df.count() > 0
