import re
from collections import Counter
from itertools import permutations

from compare import difference, spark_rows

from flowtables.llm import filter_audit

DOCS = "doc_id long, text string, lang string, mask int, id string, part string"
LABELS = "doc_id long, quality int, toxic int, good int"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute(docs, labels, letters="ABCDE"):
    """Each order applied filter by filter to lists of documents."""
    rows = []
    ids = {}
    for doc, text, *_ in docs:
        if doc is not None:
            ids[text or ""] = min(doc, ids.get(text or "", doc))
    for doc, text, lang, *_ in docs:
        text, own = text or "", words_of(text or "")
        fails = {"A": len(own) < 100, "B": 100 * len(set(own)) < 80 * len(own),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": doc is not None and ids[text] < doc}
        said = [l for l in labels if doc is not None and l[0] == doc]
        rows.append((lang or "", {f for f in letters if fails[f]}, any(l[1] == 1 for l in said),
                     any(l[2] == 1 for l in said)))
    found = []
    for part in {r[0] for r in rows}:
        own, total = [r for r in rows if r[0] == part], Counter()
        steps = []
        for order in permutations(letters):
            left = own
            for step, letter in enumerate(order, 1):
                removed = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                total[letter] += len(removed)
                steps.append((part, "".join(order), step, len(left), len(removed),
                              sum(letter in r[1] for r in own) - len(removed),
                              sum(r[1] == {letter} for r in own), sum(r[2] for r in removed),
                              sum(r[3] for r in removed), letter))
        found += [(*s[:-1], total[s[-1]]) for s in steps]
    return found


def long(*tail):
    return " ".join(f"w{n}" for n in range(120)) + " " + " ".join(tail)


CASES = [
    (1, None, "en", 0, "", ""), (2, "", None, 0, "", ""), (3, long(), "en", 0, "", ""), (4, long(), "de", 0, "", ""),
    (5, long(), "en", 0, "", ""), (5, long(), "en", 0, "", ""), (3, long(), "en", 0, "", ""),
    (None, long(), "en", 0, "", ""), (None, None, None, 0, "", ""), (6, "a " * 200, "en", 0, "", ""),
    (7, "SHOUT " * 120, "", 0, "", ""), (8, long("#", "B" * 90), "fr", 0, "", ""), (9, "ÀÉ X é", "fr", 0, "", ""),
    (10, long() * 300, "fr", 0, "", ""), (11, long("|"), "a\x00b", 0, "", ""), (None, long("%"), "de", 0, "", "")]
MARKS = [(3, 1, None, 0), (3, 0, 1, 0), (5, 1, 1, 0), (6, None, 1, 0), (None, 1, 1, 0), (99, 1, 1, 0), (8, 2, 0, 0)]


def test_audit_equals_filtering_document_by_document(spark):
    docs, labels = spark.createDataFrame(CASES, DOCS), spark.createDataFrame(MARKS, LABELS)
    found = filter_audit.interactions(filter_audit.failure_counts(docs, labels))
    assert len(found.columns) == 10
    assert sorted(map(tuple, found.collect())) == sorted(brute(CASES, MARKS))


def test_audit_equals_its_sql_on_odd_rows(spark):
    import duckdb
    import pandas as pd
    docs, labels = spark.createDataFrame(CASES, DOCS), spark.createDataFrame(MARKS, LABELS)
    connection = duckdb.connect()
    connection.register("documents", pd.DataFrame(CASES, columns=docs.columns).astype({"doc_id": "Int64"}))
    connection.register("labels", pd.DataFrame(MARKS, columns=labels.columns).astype("Int64"))
    found = spark_rows(filter_audit.interactions(filter_audit.failure_counts(docs, labels)))
    from compare import sql_rows
    assert difference(found, sql_rows(connection, filter_audit.audit_sql())) is None


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame(CASES, DOCS), spark.createDataFrame(MARKS, LABELS)
    assert filter_audit.interactions(filter_audit.failure_counts(docs.limit(0), labels)).count() == 0
    found = filter_audit.interactions(filter_audit.failure_counts(docs, labels.limit(0)))
    assert {(r.good_lost, r.toxic_lost) for r in found.collect()} == {(0, 0)}


def test_swaps_visit_every_order_once():
    for count in range(1, 6):
        order, seen = list(range(count)), set()
        seen.add(tuple(order))
        for level in filter_audit.swaps(count):
            order[level], order[level + 1] = order[level + 1], order[level]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(permutations(range(count))))


def test_diagrams_share_nodes_and_drop_filters_that_nothing_fails():
    masks = {frozenset(): (5, 1, 0), frozenset("A"): (2, 0, 0), frozenset("AC"): (1, 0, 1)}
    diagram = filter_audit.Diagram("ABC", masks)
    assert not any(node and node[0] == "B" for node in diagram.nodes)
    for level in (0, 1, 0, 1, 0):
        before = dict(zip(diagram.order, diagram.steps()))
        diagram.swap(level)
        assert diagram.weights[diagram.root] == (8, 1, 1) and before
    assert diagram.steps()[-1] == (5, 1, 0)
