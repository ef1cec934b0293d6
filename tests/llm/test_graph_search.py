import math
import random

import numpy as np
import pytest

from flowtables.llm import graph_search

SCHEMA = "vec_id long, embedding array<float>, score string"


def cosine(a, b):
    a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
    return (a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum()))


def fine(vector):
    return vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector)


def brute(rows, queries, k):
    found = {}
    valid = sorted({(i, tuple(np.array(v, np.float32).tolist())) for i, v in rows if i is not None and fine(v)})
    for query, vector in queries:
        if query is not None and fine(vector):
            pairs = sorted((-cosine(vector, v), i) for i, v in valid if i != query and len(v) == len(vector))
            found[query] = [(i, -s) for s, i in pairs[:k]]
    return found


def searched(spark, rows, queries, **options):
    index = graph_search.index_vectors(
        spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA), **options)
    found = {}
    for r in graph_search.nearest(index, spark.createDataFrame(
            [(i, v, "x") for i, v in queries], SCHEMA)).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    return found


def recall(found, expected):
    """Share of the true scores that were reached: ties may be broken either way by an ulp."""
    hits = total = 0
    for query, pairs in expected.items():
        own = [s for _, s in found.get(query, [])]
        total += len(pairs)
        hits += sum(s >= pairs[-1][1] - 1e-12 for s in own)
    return hits / total


def test_recall_on_all_vectors(spark):
    from flowtables.llm.queries import op5_neighbours
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    expected = brute(rows, [(i, v) for i, v in rows if i % 50 == 0], 5)
    found = {}
    for r in op5_neighbours(spark, folder).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        vectors = dict(rows)
        assert abs(r.score - cosine(vectors[r.query_id], vectors[r.vec_id])) < 1e-12
    assert found.keys() == expected.keys() and all(len(v) == 5 for v in found.values())
    assert recall(found, expected) >= 0.95


def test_small_and_odd_tables(spark):
    random.seed(6)
    vector = lambda: [random.gauss(0, 1) for _ in range(4)]
    rows = [(i, vector()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(40)] + [(3, rows[3][1]), (7, vector())]
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 0.0, 0.0]), (None, vector()),
             (204, [float("nan")] * 4), (205, [float("inf"), 0.0, 0.0, 0.0]), (206, [1.0, 2.0]), (207, [2.0, 1.0]),
             (208, [1e30, 1e30, -1e30, 0.0]), (209, [1e-30, 0.0, 0.0, 0.0])]
    queries = rows[:5] + rows[-12:]
    expected = brute(rows, queries, 5)
    found = searched(spark, rows, queries)
    assert found.keys() == {q for q, pairs in expected.items() if pairs}
    for query, pairs in found.items():
        assert [round(s, 9) for _, s in pairs] == [round(s, 9) for _, s in expected[query]]
    assert [i for i, _ in found[3]] == [100, 101, 102, 103, 104]
    assert recall(searched(spark, rows, queries, shard_rows=20), expected) == 1
    assert searched(spark, rows[:1], rows[:1]) == {} and searched(spark, [], rows[:1]) == {}
    assert searched(spark, rows[:4], []) == {}


def test_pruning_keeps_the_nearest_and_drops_what_it_covers():
    vectors = graph_search.unit(np.array([[1, 0], [1, 0.1], [1, 0.12], [1, -0.3], [-1, 0.0]]))
    assert graph_search.prune(vectors, 0, np.array([0, 1, 2, 3, 4, -1]), 2, 1.2).tolist() == [1, 3]
    assert graph_search.prune(vectors, 0, np.array([1, 2, 3]), 1, 1.2).tolist() == [1]


def test_more_neighbours_than_kept_ids_is_an_error(spark):
    rows = spark.createDataFrame([(i, [1.0, 2.0], "x") for i in range(12)], SCHEMA)
    with pytest.raises(ValueError):
        graph_search.nearest(graph_search.index_vectors(rows), rows, k=6)
    found = graph_search.nearest(graph_search.index_vectors(rows, keep=11), rows.where("vec_id = 0"), k=10)
    assert [r.vec_id for r in found.orderBy("rank").collect()] == list(range(1, 11))


def test_double_vectors_are_scored_as_they_are(spark):
    near = [[1.0, 1e-9], [1.0, 3e-9], [1.0, 1e-3], [1e200, 1e200], [1e-200, -1e-200]]
    rows = spark.createDataFrame(list(enumerate(near)), "vec_id long, embedding array<double>")
    found = graph_search.nearest(graph_search.index_vectors(rows), rows).collect()
    assert len(found) == 20
    for r in found:
        a, b = (np.array(near[i]) / max(map(abs, near[i])) for i in (r.query_id, r.vec_id))
        assert abs(r.score - (a @ b) / math.sqrt((a @ a) * (b @ b))) < 1e-15
    assert all(r.vec_id not in (0, 1) or r.score > 0.9 for r in found if r.query_id == 2)
    asked = spark.createDataFrame([(9, [1.0, 0.1])], "vec_id long, embedding array<double>")
    index = graph_search.index_vectors(spark.createDataFrame([(1, [0.0, 1.0], "x")], SCHEMA))
    row, = graph_search.nearest(index, asked).collect()
    assert abs(row.score - 0.1 / math.sqrt(1.01)) < 1e-15
