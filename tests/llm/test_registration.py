import re

import pytest
from compare import database, difference, spark_rows, sql_rows

from __spark_entry__ import oracle_sql, queries


def test_each_operator_and_the_pipeline_have_one_query():
    names = [re.match(r"op(\d+)_", name) for name in queries()]
    assert sorted(int(m[1]) for m in names if m) == list(range(1, 14))
    assert "pipeline" in queries() and "pipeline" not in oracle_sql()


@pytest.mark.parametrize("name", ["op1_licenses", "op2_warc", "op12_filter_audit", "op13_prefix_trie"])
def test_query_equals_its_sql(spark, small, name):
    found = spark_rows(queries()[name](spark, small))
    assert sum(found[2].values()) > 0
    assert difference(found, sql_rows(database(small), oracle_sql()[name])) is None
