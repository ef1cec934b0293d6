import random
import re
from itertools import combinations

import numpy as np
import pytest
from compare import database, difference, spark_rows, sql_rows

from flowtables.llm import minmax
from flowtables.llm.components import components, extended
from flowtables.llm.queries import ORACLES, op4_near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    own = WORD.findall((text or "").translate(str.maketrans(minmax.UPPER, minmax.LOWER)))
    size = min(size, len(own))
    return {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if size else set()


def brute(rows, size, similarity=80):
    texts = sorted({frozenset(shingles(t, size)) for d, t in rows if d is not None}, key=str)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in combinations(range(len(texts)), 2):
        common = len(texts[i] & texts[j])
        if common and 100 * common >= similarity * len(texts[i] | texts[j]):
            parent[root(i)] = root(j)
    place = {text: at for at, text in enumerate(texts)}
    lowest = {}
    for doc, text in rows:
        if doc is not None and shingles(text, size):
            at = root(place[frozenset(shingles(text, size))])
            lowest[at] = min(doc, lowest.get(at, doc))
    found = []
    for doc, text in rows:
        own = frozenset(shingles(text, size))
        component = None if doc is None else (lowest[root(place[own])] if own else doc)
        found.append((doc, len(own), component, component is None or doc == component))
    return sorted(found, key=str)


def result(spark, rows, **options):
    table = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, kept int")
    return sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept)
                   for r in minmax.near_groups(table, **options).collect()], key=str)


def near_rows(seed, groups, copies):
    """Groups around a text with edits that leave similarities around 0.8."""
    random.seed(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows = []
    for _ in range(groups):
        base = random.choices(vocabulary, k=random.randint(5, 120))
        for _ in range(copies):
            own = list(base)
            for _ in range(random.randint(0, max(1, len(own) // 9))):
                own[random.randrange(len(own))] = random.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, random.choice([" ", "\n"]).join(own).upper()
                         if random.random() < 0.2 else " ".join(own)))
    extra = [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "One"), (5005, "one two"),
             (None, rows[0][1]), (None, None), (5006, rows[0][1]), (5006, rows[0][1]), (5006, "other words here")]
    return rows + extra


@pytest.mark.parametrize("seed,groups,copies,size", [(1, 30, 4, 2), (2, 3, 70, 2), (3, 3, 60, 5)])
def test_against_brute_force(spark, seed, groups, copies, size):
    rows = near_rows(seed, groups, copies)
    assert result(spark, rows, shingle=size) == brute(rows, size)


def test_the_size_of_small_bands_does_not_matter(spark, monkeypatch):
    rows = near_rows(7, 4, 25)
    for small in (1, 3):
        monkeypatch.setattr(minmax, "SMALL", small)
        assert result(spark, rows, shingle=2) == brute(rows, 2)


def test_chains(spark):
    """Each text is similar to the next one only."""
    words = [f"c{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[3 * i:3 * i + 60])) for i in range(60)]
    found = brute(rows, 2)
    assert {r[2] for r in found} == {41} and result(spark, rows, shingle=2) == found


def test_one_document_of_each_group_stays(spark):
    rows = near_rows(4, 6, 8)
    table = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int")
    kept = [(r.doc_id, r.text) for r in minmax.keep_one(table, shingle=5).collect()]
    expected = {(row[0], row[1]) for row, found in zip(
        sorted(rows, key=str), sorted(rows, key=str)) if found} & {
        (d, t) for d, t in rows if (d, len(shingles(t, 5)), d, True) in brute(rows, 5) or d is None}
    assert sorted(kept, key=str) == sorted(expected, key=str)
    assert minmax.keep_one(table.limit(0)).count() == 0


def test_minima_and_maxima_estimate_the_similarity():
    rng = np.random.default_rng(3)
    shared, other = rng.integers(1, 1 << 63, (2, 6000), dtype=np.uint64)
    maker = minmax.MinMax(2000, 1)
    a = maker.keys(np.concatenate([shared[:4000], other[:1000]]))
    b = maker.keys(np.concatenate([shared[:4000], other[1000:2000]]))
    assert abs((a == b).mean() - 4000 / 6000) < 0.03
    assert abs((a[:2000] == b[:2000]).mean() - (a[2000:] == b[2000:]).mean()) < 0.06


def test_components(spark):
    random.seed(8)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(90)]
    labels = {i: i for e in edges for i in e}
    for _ in range(300):
        for a, b in edges:
            labels[a] = labels[b] = min(labels[a], labels[b])
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    looped = {i for e in edges for i in e if e[0] != e[1]}
    assert {r.node: r.label for r in found} == {n: v for n, v in labels.items() if n in looped}
    assert len(found) == len({r.node for r in found})
    frame = lambda part: spark.createDataFrame(part, "a long, b long")
    grown = extended(components(frame(edges[:150])), frame(edges[150:])).collect()
    assert sorted(map(tuple, grown)) == sorted(map(tuple, found))


def test_sql_agrees(spark, small):
    found = spark_rows(op4_near_dedup(spark, small))
    assert difference(found, sql_rows(database(small), ORACLES["op4_near_dedup"])) is None


def test_empty_table(spark):
    assert result(spark, []) == []
