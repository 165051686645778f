"""Queries of the training-data operators beside their check SQL, where there is one."""

import pytest

from tidemark.llm.queries import CHECKS, QUERIES
from tidemark.plans.compare import _rows, connect

PATH = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_matches_its_check(spark, name):
    cursor = connect(PATH).execute(CHECKS[name])
    names = [c[0] for c in cursor.description]
    want = _rows(names, cursor.fetchall())
    frame = QUERIES[name](spark, PATH)
    assert sorted(frame.columns) == sorted(names)
    assert _rows(frame.columns, frame.collect()) == want and want
