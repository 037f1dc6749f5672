"""Every query of the subpackage runs on the smallest tables, and has the rows of its SQL where it has one."""

import os

import pytest

from cairn.llm import queries
from tests.conftest import SMALL, normalised

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(as_in_production, oracle, name):
    df = queries.QUERIES[name](as_in_production, SMALL)
    rows = df.collect()
    if name in queries.SQL:
        columns, expected = oracle(queries.SQL[name])
        assert sorted(columns) == sorted(df.columns)
        assert normalised(df.columns, rows) == normalised(columns, expected)
    else:
        assert rows or name in ("p9_items", "p9_method")


def test_methods_come_before_what_does_not_follow_them():
    names = list(queries.QUERIES)
    assert names.index("p9_method") < names.index("p9_found")
