"""Every registered query against its SQL, and properties of the plans."""

import pytest

import compare
from __spark_entry__ import entry, oracle_sql, queries
from flowtables.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def connection(small):
    return compare.database(small)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= queries().items() and ORACLES.items() <= oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, small, connection, name):
    result = compare.spark_rows(QUERIES[name](spark, small))
    assert sum(result[2].values()) > 0
    assert compare.difference(result, compare.sql_rows(connection, ORACLES[name])) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


BATCH = sorted(name for name in QUERIES if not name.startswith("stream_"))


@pytest.mark.parametrize("name", BATCH)
def test_no_nested_loops_and_no_python(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    assert ("ArrowEvalPython" in plan) == (name == "call_user_function")


@pytest.mark.parametrize("name, columns", [
    ("window_hopping", "ts:timestamp_ntz,event_type:string,value:double"),
    ("count_distinct", "user_id:bigint,event_type:string,value:double,props:string"),
    ("topk", "event_id:bigint,user_id:bigint"),
    ("as_value", "user_id:bigint,value:double"),
    ("explode_actions", "doc_id:bigint,text:string,lang:string")])
def test_scans_read_only_needed_columns(spark, small, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan_of(QUERIES[name](spark, small))


@pytest.mark.parametrize("name, pushed", [
    ("where_and", "GreaterThan(value,10.0)"),
    ("where_and_or", "EqualTo(event_type,signup)"),
    ("left_join_table", "GreaterThanOrEqual(c_acctbal,0.0)")])
def test_filters_reach_the_scan(spark, small, name, pushed):
    assert pushed in plan_of(QUERIES[name](spark, small))


@pytest.mark.parametrize("name", ["window_tumbling", "agg_basic", "count_distinct",
                                  "table_latest_per_key", "window_session", "agg_as_map"])
def test_aggregates_combine_before_the_first_shuffle(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    before = plan[plan.rindex("Exchange hashpartitioning"):]
    assert "partial_" in before or "Aggregate(keys=" in before or "HashAggregate" in before
