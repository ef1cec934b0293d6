import itertools
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowtables.operators import joins, tables
from flowtables import session
from flowtables.session import replace_table, written


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_left_join_any_equals_the_or_condition(spark):
    draw = random.Random(5)
    pick = lambda n: draw.choice([None, *range(n)])
    left_rows = [(i, pick(6), pick(6)) for i in range(60)]
    right_rows = [(100 + i, pick(8), pick(8)) for i in range(12)]
    left = spark.createDataFrame(left_rows, "i int, a int, b int")
    right = spark.createDataFrame(right_rows, "j int, c int, d int")
    found = joins.left_join_any(left, right, [left["a"] == right["c"], left["b"] == right["d"]])
    expected = []
    for row in left_rows:
        matches = [other for other in right_rows
                   if (row[1] is not None and row[1] == other[1])
                   or (row[2] is not None and row[2] == other[2])]
        expected += [row + m for m in matches] or [row + (None, None, None)]
    assert rows_of(found) == sorted(expected, key=str)


@pytest.mark.parametrize("band", [0.5, 3.0, 100.0])
def test_range_join_finds_every_pair_once(spark, band):
    values = [(i, i * 0.7 - 5) for i in range(40)] + [(99, None)]
    ranges = [("wide", -10.0, 30.0), ("edge", 1.3, 2.0), ("none", 5.0, 5.0), ("open", None, 3.0)]
    left = spark.createDataFrame(values, "i int, v double")
    right = spark.createDataFrame(ranges, "name string, lo double, hi double")
    found = joins.left_join_range(left, right, "v", "lo", "hi", band).select("i", "name")
    expected = []
    for i, v in values:
        names = [n for n, lo, hi in ranges
                 if v is not None and lo is not None and lo <= v < hi]
        expected += [(i, n) for n in names] or [(i, None)]
    assert rows_of(found) == sorted(expected, key=str)


def test_range_join_with_equal_columns(spark):
    left = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 9.0)], "k string, v double")
    right = spark.createDataFrame([("a", 0.0, 2.0, "x"), ("b", 5.0, 6.0, "y")],
                                  "k string, lo double, hi double, name string")
    found = joins.left_join_range(left, right, "v", "lo", "hi", 1.0, on=["k"])
    assert rows_of(found.select("k", "name")) == [("a", "x"), ("b", None), ("c", None)]


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y"), (None, 3, "z")],
                               "k string, at bigint, v string")
    latest = tables.latest_per_key(df, ["k"], F.col("at"))
    assert rows_of(latest) == sorted([("a", 2, None), ("b", 1, "y"), (None, 3, "z")], key=str)


def test_rekeyed_rows_of_a_key_share_a_partition(spark):
    df = tables.rekeyed(spark.range(100).select((F.col("id") % 7).alias("k")), "k", 5)
    found = df.groupBy("k").agg(F.collect_set("partition").alias("p")).collect()
    assert all(len(r["p"]) == 1 and 0 <= r["p"][0] < 5 for r in found)


def test_snapshot_diff(spark):
    desired = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "n")], "k int, v string")
    observed = spark.createDataFrame([(2, "b"), (3, ""), (4, "d"), (None, "n")], "k int, v string")
    found = {r["k"]: r["action"] for r in tables.snapshot_diff(desired, observed, ["k"]).collect()}
    assert found == {1: "create", 2: "keep", 3: "replace", 4: "drop", None: "keep"}


def levels(spark, nodes, edges):
    found = tables.dependency_levels(
        spark.createDataFrame([(n,) for n in nodes], "node string"),
        spark.createDataFrame(edges, "node string, needs string"))
    return {r["node"]: r["level"] for r in found.collect()}


def test_dependency_levels(spark):
    assert levels(spark, "abcde", [("b", "a"), ("c", "b"), ("c", "a"), ("d", "outside")]) == {
        "a": 0, "b": 1, "c": 2, "d": 0, "e": 0}
    assert levels(spark, "ab", [("a", "outside")]) == {"a": 0, "b": 0}


def test_dependency_cycles_have_no_level(spark):
    edges = [("b", "a"), ("c", "b"), ("b", "c"), ("d", "c"), ("s", "s")]
    assert levels(spark, "abcds", edges) == {"a": 0, "b": None, "c": None, "d": None, "s": None}


def test_dependency_levels_of_a_random_graph(spark):
    draw = random.Random(3)
    nodes = [f"n{i}" for i in range(40)]
    # A third of all edges need the same node.
    edges = {(nodes[j], nodes[i]) for i, j in itertools.combinations(range(40), 2)
             if draw.random() < 0.05}
    edges |= {(n, "n0") for n in nodes[1:]}
    expected = {}
    for n in nodes:
        needs = [b for a, b in edges if a == n]
        expected[n] = 1 + max((expected[b] for b in needs), default=-1)
    assert levels(spark, nodes, sorted(edges)) == expected


def test_a_null_order_is_older_than_any_other(spark):
    df = spark.createDataFrame([("a", None, 5), ("b", None, 1), ("b", 2, 7)], "k string, at int, v int")
    found = tables.latest_per_key(df, ["k"], F.col("at"))
    assert sorted(tuple(r) for r in found.collect()) == [("a", None, 5), ("b", 2, 7)]


def test_fingerprints_of_different_rows_differ(spark):
    rows = [(1, "x\x1fy", "z"), (2, "x", "y\x1fz"), (3, None, "z"), (4, "\x00", "z"), (5, "-", "z"),
            (6, "1:x", ""), (7, "", "1:x"), (8, "", None)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    found = df.select(tables.fingerprint(F.col("a"), F.col("b")).alias("f")).distinct()
    assert found.count() == len(rows)
    swapped = spark.createDataFrame([(1, "x", "y\x1fz"), (3, "\x00", "z")], df.schema)
    actions = {r["id"]: r["action"] for r in tables.snapshot_diff(swapped, df.where("id in (1, 3)"), ["id"]).collect()}
    assert actions == {1: "replace", 3: "replace"}


def test_edges_of_unknown_nodes_do_not_count(spark):
    nodes = spark.createDataFrame([(1,), (2,), (2,)], "node bigint")
    edges = spark.createDataFrame([(2, 1), (99, 1), (1, 98)], "node bigint, needs bigint")
    found = tables.dependency_levels(nodes, edges)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0), (2, 1)]


def test_replacing_a_table(spark, fresh):
    for n in (3, 2):
        replace_table(spark.range(n), fresh("table"))
        assert spark.read.parquet(fresh("table")).count() == n
    assert [p.name for p in Path(fresh("table")).parent.iterdir()] == ["table"]


def test_intermediate_tables_can_be_cleared(spark, fresh, monkeypatch):
    monkeypatch.setattr(session, "session_folder", lambda _: fresh("shared"))
    assert session.written(spark.range(3), "x").count() == 3 and session.exists(spark, fresh("shared"))
    session.clear_intermediate(spark)
    assert not session.exists(spark, fresh("shared"))


def test_levels_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    """Rounds are written tables; a chain's length shows in its logarithm only."""
    writes = []
    monkeypatch.setattr(tables, "written", lambda df, label: (writes.append(label), written(df, label))[1])
    size = 100_000
    nodes = spark.range(size).select(F.col("id").alias("node"))
    edges = spark.range(1, size).select(F.col("id").alias("node"), (F.col("id") - 1).alias("needs"))
    found = tables.dependency_levels(nodes, edges)
    assert found.where("level IS NULL OR level <> node").isEmpty() and found.count() == size
    assert len(writes) < 40 and writes.count("links") < 20


@pytest.mark.parametrize("seed", range(4))
def test_levels_of_random_graphs_with_chains_and_cycles(spark, seed):
    draw = random.Random(seed)
    nodes = [f"n{i}" for i in range(60)]
    edges = {(nodes[i], nodes[i - 1]) for i in range(1, 60) if draw.random() < 0.7}
    edges |= {(nodes[j], nodes[i]) for i, j in itertools.combinations(range(60), 2) if draw.random() < 0.01}
    edges |= {(draw.choice(nodes[:30]), draw.choice(nodes[20:])) for _ in range(seed)}
    expected, left = {}, set(nodes)
    while True:
        free = {n for n in left if not any(a == n and b in left for a, b in edges)}
        if not free:
            break
        expected.update({n: 1 + max((expected[b] for a, b in edges if a == n), default=-1) for n in free})
        left -= free
    expected.update(dict.fromkeys(left))
    assert levels(spark, nodes, sorted(edges)) == expected


def test_sparse_diff_equals_the_plain_one(spark):
    desired = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("v"))
    observed = desired.where("k % 900 <> 3").withColumn("v", F.when(F.col("k") % 1100 == 9, None).otherwise(
        F.col("v"))).unionByName(spark.createDataFrame([(9001, "x"), (None, "n"), (-5, "m")], "k long, v string"))
    desired = desired.unionByName(spark.createDataFrame([(None, "n"), (-5, None)], "k long, v string"))
    found = tables.snapshot_diff_sparse(desired, observed, "k")
    assert rows_of(found) == rows_of(tables.snapshot_diff(desired, observed, ["k"]))


def test_sparse_diff_compares_repeated_keys_as_bags(spark):
    rows = [(1, "a"), (1, "b"), (2, "c"), (2, "c"), (3, "d")]
    desired = spark.createDataFrame(rows, "k int, v string")
    other = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, "d"), (3, "d")], "k int, v string")
    assert rows_of(tables.snapshot_diff_sparse(desired, other, "k", (4, 0))) == [
        (1, "keep"), (1, "keep"), (2, "replace"), (3, "replace")]


def test_sparse_diff_shuffles_little(spark):
    """Rows of ranges that do not differ stay where they are."""
    desired = spark.range(200_000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    observed = desired.withColumn("v", F.when(F.col("k") % 1000 == 77, "x").otherwise(F.col("v")))
    found = tables.snapshot_diff_sparse(desired, observed, "k")
    assert {r.action: r["count"] for r in found.groupBy("action").count().collect()} == {
        "replace": 200, "keep": 199_800}
    seen = [r.k for r in found.where("action = 'replace'").collect()]
    assert all(k % 1000 == 77 for k in seen)
    differing = {k >> 4 for k in seen}
    assert 16 * len(differing) < 0.02 * 200_000


def as_of_brute(rows, versions):
    found = []
    for row_id, key, at in rows:
        known = [v for v in versions if key is not None and v[0] == key and v[1] is not None
                 and at is not None and v[1] <= at]
        best = max(known, key=lambda v: (v[1], v[2]), default=(None, None, None))
        found.append((row_id, key, at, best[1], best[2]))
    return sorted(found, key=str)


@pytest.mark.parametrize("band", [7.0, 100.0, 1e6])
def test_left_join_as_of(spark, band):
    draw = random.Random(5)
    start = datetime(2024, 1, 1)
    times = [start + timedelta(seconds=draw.randrange(-300, 900)) for _ in range(200)] + [None]
    rows = [(n, draw.choice(["hot", "hot", "cold", None]), draw.choice(times)) for n in range(150)]
    versions = [(draw.choice(["hot", "cold", "rare", None]), draw.choice(times), n) for n in range(60)]
    found = joins.left_join_as_of(
        spark.createDataFrame(rows, "id int, k string, at timestamp"),
        spark.createDataFrame(versions, "k string, since timestamp, v int"), ["k"], "at", "since",
        order=F.col("v"), band=band)
    assert rows_of(found) == as_of_brute(rows, versions)
    nothing = joins.left_join_as_of(found.select("id", "k", "at"), spark.createDataFrame(
        [], "k string, since timestamp, v int"), ["k"], "at", "since")
    assert {(r.since, r.v) for r in nothing.collect()} == {(None, None)}
