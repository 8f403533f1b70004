from __future__ import annotations

import os

import pytest

from siftmill.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_match_sql(spark, name):
    import verify

    want = verify.connect(DATA).execute(oracle_sql()[name]).df()
    assert verify.canonical(queries()[name](spark, DATA).toPandas()) == verify.canonical(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["p8_fill", "p9_report", "p10_found", "p10_segments"])
def test_queries_run(spark, name):
    assert queries()[name](spark, DATA).count() > 0
