import numpy as np
import pytest

import corpus_pipeline
from test_decontamination import brute as items_in
from test_minmax import brute as groups_of
from test_pii import brute as spans_in
from test_tokens import check_packing


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """The documents before each stage, and the last result."""
    docs, found = spark.read.parquet(f"{small}/documents.parquet"), []
    odd = spark.createDataFrame(
        [(90_001, None, None, None, None), (90_002, "", "en", "s", 0), (90_003, "12 !? 34", "en", "s", 8),
         (None, "Some words without an id here.", None, None, 5), (90_004, "wörter " * 4000, "de", "s", 28_000)],
        docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(3))
    for name, stage in corpus_pipeline.STAGES:
        found.append(docs.collect())
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, small).write.parquet(path)
        columns = docs.columns
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
    return found + [docs.collect()]


def test_language_rejects_only_what_has_no_letters(stages):
    expected = [r for r in stages[0] if r.text and any(c.isalpha() for c in r.text)]
    assert sorted(map(str, stages[1])) == sorted(map(str, expected))


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1]]
    kept = {(d, t) for (d, t) in rows if d is None or (d, True) in {
        (f[0], f[3]) for f in groups_of(rows, 5)}}
    assert sorted(((r.doc_id, r.text) for r in stages[2]), key=str) == sorted(kept, key=str)


def test_benchmark_items_are_gone(stages, spark, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    expected = [r for r in stages[2] if not items_in(r.text, items)]
    assert len(expected) < len(stages[2])
    assert sorted(map(str, stages[3])) == sorted(map(str, expected))


def test_personal_data_is_masked_and_other_texts_unchanged(stages):
    before = {r.doc_id: r for r in stages[3]}
    assert len(before) == len(stages[4])
    for row in stages[4]:
        old = before[row.doc_id]
        spans = spans_in(old.text)
        assert spans_in(row.text) == [] and row.n_chars == len(row.text)
        if not spans:
            assert row.text == old.text
        text, reached = "", 0
        for kind, start, end in sorted(spans, key=lambda s: s[1:]):
            text += old.text[reached:start] + (f"<{kind.upper()}>" if start >= reached else "")
            reached = max(reached, end)
        assert row.text == text + old.text[reached:]


def test_all_that_is_left_is_packed(stages):
    assert check_packing(stages[5], [r.text for r in stages[4]], 2048, 1) < 0.03
    assert sum(len(np.frombuffer(r.ids, "<u4")) for r in stages[5]) > 10_000


def test_run_is_the_stages_in_turn(spark, small):
    rows = corpus_pipeline.run(spark, small)
    assert rows.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert rows.count() > 100


def test_empty_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0


def test_unlabelled_documents_stay(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20).selectExpr(
        "doc_id", "text", "cast(null as string) AS lang", "source", "n_chars")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, small)
    assert kept.count() == sum(any(c.isalpha() for c in r.text or "") for r in docs.collect()) > 0
