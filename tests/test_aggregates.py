import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowtables.operators import aggregates as A
from flowtables.operators import lists


def by_key(df, name):
    return {r["k"]: r[name] for r in df.collect()}


ROWS = [("a", 1, 5), ("a", 2, None), ("a", 3, 7), ("a", 4, 7), ("b", 5, None), (None, 6, 1),
        (None, 7, None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "k string, at bigint, v bigint")


def test_latest_and_earliest_skip_nulls(rows):
    value, order = F.col("v"), F.col("at")
    assert by_key(rows.groupBy("k").agg(A.latest("x", value, order).over_rows()), "x") == {
        "a": 7, "b": None, None: 1}
    assert by_key(rows.groupBy("k").agg(A.earliest("x", value, order).over_rows()), "x") == {
        "a": 5, "b": None, None: 1}


def test_two_steps_equal_one(rows):
    value, order = F.col("v"), F.col("at")
    aggs = [A.count_rows("n"), A.count_values("nv", value), A.count_when("big", value > 5),
            A.total("t", value), A.smallest("lo", value), A.largest("hi", value),
            A.latest("l", value, order), A.earliest("e", value, order)]
    one = rows.groupBy("k").agg(*[a.over_rows() for a in aggs])
    slices = rows.groupBy("k", (order % 2).alias("slice")).agg(
        *[c for a in aggs for c in a.per_slice()])
    two = slices.groupBy("k").agg(*[a.over_slices() for a in aggs])
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_topk_keeps_duplicates_and_empty_groups(rows):
    assert by_key(A.topk(rows, ["k"], F.col("v"), 2, "top"), "top") == {
        "a": [7, 7], "b": [], None: [1]}
    assert by_key(A.topk_distinct(rows, ["k"], F.col("v"), 2, "top"), "top") == {
        "a": [7, 5], "b": [], None: [1]}


def test_topk_beyond_the_rank_limit(spark):
    rows = spark.range(0, 5000, 1, 7).select(F.lit("h").alias("k"), F.col("id").alias("v"))
    top = A.topk(rows, ["k"], F.col("v"), 1500, "top").first()["top"]
    assert top == list(range(4999, 3499, -1))


def test_topk_is_limited_before_the_shuffle(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    plan = A.topk(events, ["user_id"], F.col("value"), 3, "t")._jdf.queryExecution().toString()
    before_shuffle = plan[plan.rindex("Exchange"):]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


def test_first_occurrence(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 9)], "k string, at bigint")
    first = A.first_occurrence(rows, ["k"], "at")
    assert sorted(tuple(r) for r in first.collect()) == [("a", 1), ("b", 9)]


def test_lists_keep_nulls_and_order(rows):
    found = lists.list_parts(rows, ["k"], F.col("at"), {"v": F.col("v")})
    assert {r["k"]: (r["part"], r["v"]) for r in found.collect()} == {
        "a": (0, [5, None, 7, 7]), "b": (0, [None]), None: (0, [1, None])}


@pytest.mark.parametrize("part_size", [1, 3, 7, 50, 1000])
def test_parts_of_a_hot_group_add_up(spark, part_size):
    """One key and the null key hold two thirds of the rows."""
    draw = random.Random(part_size)
    order = draw.sample(range(10_000), 300)
    data = [(draw.choice(["hot", None, f"k{i % 20}"]), at, draw.choice([None, i]))
            for i, at in enumerate(order)]
    df = spark.createDataFrame(data, "k string, at bigint, v bigint").repartition(5)
    found = lists.list_parts(df, ["k"], F.col("at"),
                             {"v": F.col("v"), "at": F.col("at")}, part_size).collect()
    expected = {}
    for k, at, v in sorted(data, key=lambda row: row[1]):
        expected.setdefault(k, []).append((at, v))
    for k, items in expected.items():
        parts = sorted((r for r in found if r["k"] == k), key=lambda r: r["part"])
        assert [r["part"] for r in parts] == list(range(len(parts)))
        assert all(len(r["v"]) == part_size for r in parts[:-1])
        assert [pair for r in parts for pair in zip(r["at"], r["v"])] == items


@pytest.mark.parametrize("part_size", [1, 2, 7, 10_000])
def test_any_order_gives_one_list_for_any_part_size(spark, part_size):
    """Null orders come last; timestamps below a second and pairs count in full."""
    draw = random.Random(4)
    data = [(f"k{i % 3}", draw.choice([None, i % 2]), i if i % 9 else None,
             datetime(2024, 1, 1, 0, 0, 0, draw.randrange(1_000_000)), i) for i in range(60)]
    df = spark.createDataFrame(data, "k string, p int, o bigint, ts timestamp, v int").repartition(4)
    orders = {"ts": lambda r: (r[3],), "pair": lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or 0),
              "o": lambda r: (r[2] is None, r[2] or 0)}
    columns = {"ts": F.col("ts"), "pair": F.struct("p", "o"), "o": F.col("o")}
    for name, order in columns.items():
        found = lists.list_parts(df, ["k"], order, {"v": F.col("v")}, part_size).orderBy("part").collect()
        for key in ("k0", "k1", "k2"):
            rows = sorted((r for r in data if r[0] == key), key=lambda r: (orders[name](r), r[4]))
            assert [v for r in found if r["k"] == key for v in r["v"]] == [r[4] for r in rows]


def test_transitions_follow_the_last_occurrence(spark):
    draw = random.Random(2)
    data = [(draw.choice(["hot", "hot", None, "x"]), at, draw.choice(["a", "b", "c", None, f"i{at}"]))
            for at in draw.sample(range(5000), 400)]
    df = spark.createDataFrame(data, "k string, at bigint, v string").repartition(6)
    expected = set()
    for key in ("hot", None, "x"):
        items = [v for k, _, v in sorted(data, key=lambda r: r[1]) if k == key]
        following = dict(zip(items, [*items[1:], None]))
        expected |= {(key, item, after) for item, after in following.items() if item is not None}
    found = lists.transitions(df, ["k"], F.col("at"), F.col("v")).collect()
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)


def test_map_last_value_wins_even_when_null(spark):
    df = spark.createDataFrame(
        [("g", "a", 1, 1), ("g", "a", None, 2), ("g", None, 5, 3), ("g", "b", 2, 4), ("h", None, 1, 5)],
        "k string, m string, v int, at bigint")
    found = lists.map_parts(df, ["k"], F.col("m"), F.col("v"), F.col("at"), "x").collect()
    assert [(r["k"], r["part"], r["x"]) for r in found] == [("g", 0, {"a": None, "b": 2})]


def test_map_parts_of_a_hot_group_add_up(spark):
    df = spark.range(0, 2000, 1, 6).select(
        F.when(F.col("id") % 3 > 0, "hot").alias("k"), (F.col("id") % 701).alias("m"),
        F.col("id").alias("v"))
    found = lists.map_parts(df, ["k"], F.col("m"), F.col("v"), F.col("v"), "x", parts=16).collect()
    for key, keep in ((None, lambda i: i % 3 == 0), ("hot", lambda i: i % 3 > 0)):
        merged = {}
        parts = [r["x"] for r in found if r["k"] == key]
        for part in parts:
            assert not set(part) & set(merged)
            merged.update(part)
        assert merged == {i % 701: i for i in range(2000) if keep(i)}
        assert len(parts) > 1
