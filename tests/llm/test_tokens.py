import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowtables.llm import packing, token_counts
from flowtables.llm.byte_pairs import locate

PATH = locate("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
MERGER = token_counts.merger(PATH)
ENCODER = packing.encoder(PATH, locate("byte_bpe_50k.tiktoken"))
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n x", "x\n ", "don't we'll", "<|endoftext|>",
       "a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "é" * 50, "日本語 テキスト", "a\x1c b \x1c c",
       "1 2 345", "    x", "😀 😀", "zzzz" * 500, "ab " * 300, "\t\tx  \t y"]


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def encoded(text):
    return np.frombuffer(ENCODER.encode(text), dtype="<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_agree_with_the_library(text):
    assert MERGER.count(text) == len(library_ids(text))
    assert encoded(text) == library_ids(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_agrees_with_the_library(text):
    assert MERGER.count(text) == len(library_ids(text))
    assert encoded(text) == library_ids(text)


def test_all_documents_agree_with_the_library(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    for row in token_counts.token_counts(documents).collect():
        assert row.n_tokens == len(library_ids(texts[row.doc_id]))
        assert row.n_bytes == len(texts[row.doc_id].encode())
        assert row.over_limit == (row.n_tokens > 512)


def test_counts_of_odd_tables(spark):
    rows = [(1, None, "n_bytes"), (None, "", "x"), (2, "two words", "y"), (2, "two words", "y")]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = [tuple(r) for r in token_counts.token_counts(table).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit").collect()]
    assert sorted(found, key=str) == sorted(
        [(1, 0, 0, False), (None, 0, 0, False), (2, 9, 2, False), (2, 9, 2, False)], key=str)
    assert token_counts.token_counts(table.limit(0)).count() == 0


def test_merging_leaves_a_long_run_in_time():
    assert MERGER.count("a" * 200_000) == len(library_ids("a" * 200_000))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=40))
def test_best_fit_against_a_plain_search(lengths):
    free, expected = [], {}
    for at in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [f for f in free if f >= lengths[at]]
        if fits:
            free.remove(min(fits))
        room = (min(fits) if fits else 16) - lengths[at]
        expected[at] = 16 - room - lengths[at]
        if room:
            free.append(room)
    placed = packing.best_fit(lengths, 16)
    assert [offset for _, offset in placed] == [expected[at] for at in range(len(lengths))]
    used = defaultdict(list)
    for (window, offset), length in zip(placed, lengths):
        used[window].append((offset, length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 16


def check_packing(rows, texts, window, end_id):
    """Every token once, sequences without gaps; returns the share of padding."""
    expected = sorted(tuple(library_ids(text or "") + [end_id]) for text in texts)
    tokens, pieces, sequences = [], defaultdict(list), defaultdict(list)
    for row in rows:
        ids = np.frombuffer(row.ids, dtype="<u4").tolist()
        assert len(ids) == row.length > 0
        sequences[row.sequence_id].append((row.offset, row.length))
        pieces[row.doc_id, row.doc_tokens].append((row.start, ids))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    for (_, total), parts in pieces.items():
        document = []
        for start, ids in sorted(parts):
            if start == 0 and document:
                assert len(document) == total
                tokens.append(tuple(document))
                document = []
            assert start == len(document)
            document += ids
        assert len(document) == total
        tokens.append(tuple(document))
    assert sorted(tokens) == expected
    return 1 - sum(map(len, expected)) / (window * len(sequences)) if sequences else 0


def test_packing_of_all_documents(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack(documents).collect()
    assert check_packing(rows, [r.text for r in documents.collect()], 2048, 1) < 0.02
    assert all(zlib.crc32(r.ids) >= 0 for r in rows)


def test_packing_of_odd_tables(spark):
    texts = [None, "", "one", "word " * 70, "word " * 7, "x" * 999]
    table = spark.createDataFrame([(None if i == 4 else i, t, i) for i, t in enumerate(texts)],
                                  "doc_id long, text string, length long")
    for groups in (1, 3, 1000):
        rows = packing.pack(table.coalesce(1), window=16, group_documents=groups).collect()
        check_packing(rows, texts, 16, 1)
    assert packing.pack(table.limit(0)).count() == 0


@pytest.mark.parametrize("partitions", [1, 7, 100])
def test_small_partitions_give_little_padding(spark, partitions):
    texts = [" ".join(f"w{i}x{n}" for n in range(60)) for i in range(200)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(table.repartition(partitions)).collect()
    assert check_packing(rows, texts, 2048, 1) < 0.03
    rows = packing.pack(table.repartition(partitions), group_documents=20).collect()
    check_packing(rows, texts, 2048, 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=40), st.integers(0, 4))
def test_the_last_round_leaves_one_loose_window(lengths, free):
    packer = packing.Packer(16, free, 100)
    for key, length in enumerate(lengths):
        packer.add((key, 0, bytes(range(length)) * 4, length))
    packer.pack(last=True)
    filled, held = defaultdict(int), defaultdict(list)
    for key, start, length, ids, total, number, offset, loose in sorted(packer.rows, key=lambda r: r[5:7]):
        assert offset == filled[number] and len(ids) == 4 * length and not loose
        filled[number] += length
        held[key].append((start, length))
    assert sorted(filled) == list(range(100, packer.following))
    assert sum(16 - size > free for size in filled.values()) <= 1
    for key, length in enumerate(lengths):
        assert [at for start, size in sorted(held[key]) for at in range(start, start + size)] == list(range(length))


def test_the_vocabulary_files_are_public():
    assert public_tokenizers.path("byte_bpe_50k.json")
