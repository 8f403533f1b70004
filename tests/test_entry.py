from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_and_sql_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(re.fullmatch(r"\w+", n) for n in entry.queries())


def test_no_other_module_imports_the_llm_subpackage():
    root = os.path.join(os.path.dirname(entry.__file__), "siftmill")
    for folder, _, names in os.walk(root):
        for n in names:
            if n.endswith(".py") and not folder.startswith(os.path.join(root, "llm")):
                assert "siftmill.llm" not in open(os.path.join(folder, n)).read()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship_query(spark):
    got = entry.entry(spark)
    assert got.columns == ["category", "mean"] and 0 < got.count() <= 10


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["p1_found", "p6_found", "p7_found", "category_means", "frequent_itemsets", "item_model", "graph_components"])
def test_queries_match_sql(spark, name):
    import verify

    want = verify.connect(DATA).execute(entry.oracle_sql()[name]).df()
    assert verify.canonical(entry.queries()[name](spark, DATA).toPandas()) == verify.canonical(want)
