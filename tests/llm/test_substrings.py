import random
import re

import pytest
from compare import database, difference, spark_rows, sql_rows

from flowtables.llm import substrings
from flowtables.llm.queries import ORACLES, op3_substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """(words, kept) per row, by a table of the smallest id of each window."""
    smallest = {}
    tokens = [WORD.findall(text or "") for _, text in rows]
    for (doc, _), own in zip(rows, tokens):
        if doc is not None:
            for i in range(len(own) - window + 1):
                key = tuple(own[i:i + window])
                smallest[key] = min(doc, smallest.get(key, doc))
    found = []
    for (doc, _), own in zip(rows, tokens):
        gone = set()
        if doc is not None:
            for i in range(len(own) - window + 1):
                if smallest[tuple(own[i:i + window])] < doc:
                    gone.update(range(i, i + window))
        found.append((doc, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return sorted(found, key=str)


def result(spark, rows, **options):
    table = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, n_words int")
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in
                   substrings.remove_repeats(table, **options).collect()], key=str)


def random_rows(seed, count, window):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["a", "b"] * 30
    text = lambda k: random.choices(vocabulary, k=k)
    shared = [text(random.randint(window - 2, 3 * window)) for _ in range(6)] + [["x"] * 3 * window]
    rows = []
    for _ in range(count):
        parts = text(random.randint(0, 2 * window))
        for _ in range(random.randint(0, 3)):
            passage = random.choice(shared)
            start = random.randint(0, min(5, len(passage)))
            parts += passage[start:random.randint(start, len(passage))] + text(random.randint(0, 9))
        rows.append((random.randint(0, 4 * count), random.choice([" ", "\n ", "\t"]).join(parts)))
    rows += rows[:5] + [(None, rows[3][1]), (3, None), (4, ""), (5, "  \n")]
    return rows + [(doc + 1, text) for doc, text in rows[:20]]


@pytest.mark.parametrize("seed,window", [(1, 6), (2, 10), (3, 50), (4, 2)])
def test_against_brute_force(spark, seed, window):
    rows = random_rows(seed, 60, window)
    assert result(spark, rows, window=window) == brute(rows, window)


def test_buckets_do_not_matter(spark, monkeypatch):
    rows = random_rows(9, 60, 10)
    monkeypatch.setattr(substrings, "GATHERED", 3)
    assert result(spark, rows, window=10, bucket_words=100) == brute(rows, 10)


def test_a_long_text_and_a_hot_passage(spark):
    random.seed(2)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"s{i} {passage} e{i}") for i in range(300)]
    rows += [(1000, " ".join(random.choices("abcdefgh", k=70_000)) + " " + passage), (1001, rows[0][1])]
    assert result(spark, rows) == brute(rows, 50)


def test_sql_agrees(spark, small):
    found = spark_rows(op3_substring_dedup(spark, small))
    assert difference(found, sql_rows(database(small), ORACLES["op3_substring_dedup"])) is None


def test_empty_table_and_odd_window(spark):
    assert result(spark, []) == []
    with pytest.raises(ValueError):
        result(spark, [], window=5)
