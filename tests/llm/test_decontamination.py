import random
import re

import numpy as np

from flowtables.llm import decontamination as D
from flowtables.llm.shingles import shingle_set, windows


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(tokens, size=5):
    size = min(size, len(tokens))
    return {tuple(tokens[i:i + size]) for i in range(len(tokens) - size + 1)} if size else set()


def brute(text, items, share=0.5):
    """Ids of the items whose question and answer the text holds, without any retrieval."""
    tokens, found = words(text), []
    for item, value in items:
        sentences = re.split(r"(?<=[.!?])\s+", (value or "").strip())
        parts = ([" ".join(sentences[:-1]), sentences[-1]] if len(sentences) > 1 else [sentences[0]])
        sizes = [5, min(5, max(1, len(words(parts[-1])) // 3))]
        parts = [(shingles(words(p), n), min(n, len(words(p)))) for p, n in zip(parts, sizes) if words(p)]
        if item is not None and parts and all(
                len(own & {tuple(tokens[i:i + n]) for i in range(len(tokens))}) >= share * len(own) - 1e-9
                for own, n in parts):
            found.append(item)
    return sorted(set(found))


def test_all_documents_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    rows = D.contaminated(documents, benchmark).collect()
    assert len(rows) == documents.count() and any(r["items"] for r in rows)
    for row in rows:
        assert row["items"] == brute(row.text, items)


def test_planted_passages_and_odd_tables(spark):
    random.seed(4)
    vocabulary = ["".join(random.choices("abcdefgh", k=random.randint(1, 6))) for _ in range(3000)]
    text = lambda k: " ".join(random.choices(vocabulary, k=k))
    items = [(i, f"{text(12)}? {text(6)}.") for i in range(60)] + [
        (60, f"{text(9)}. {text(150)}. Yes."), (61, "Yes."), (62, None), (63, ""), (None, text(20)),
        (64, f"{text(30)}."), (64, f"{text(30)}.")]
    plant = lambda value, k: f"{text(k)}\n{value.upper().replace(' ', ', ')}\n{text(k)}"
    texts = [plant(items[i][1], k) for i, k in [(0, 0), (1, 5), (2, 50), (3, 100), (60, 300), (64, 61), (65, 63)]]
    texts += [items[5][1].split("?")[0] + " " + text(80), text(4000) + items[7][1] + text(9000),
              "yes", None, "", text(300), " ".join("changed" if i in (3, 16) else w for i, w in enumerate(items[11][1].split())), items[8][1] + " " + items[9][1], items[8][1] + " " + items[9][1]]
    documents = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, None, 1)],
                                      "doc_id long, text string, items int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"shard_items": 13, "block": 4}, {"part_words": 16}):
        rows = D.contaminated(documents, benchmark, **options).collect()
        assert len(rows) == len(texts) + 1
        for row in rows:
            expected = brute(row.text, items)
            assert row["items"] == expected, (options, row.doc_id)
    assert brute(texts[0], items) == [0] and brute(texts[4], items) == [60, 61]
    edited = items[11][1].split()
    edited[3] = edited[-2] = "changed"
    assert brute(" ".join(edited), items) == [11]
    assert D.contaminated(documents.limit(0), benchmark).count() == 0
    assert all(not r["items"] for r in D.contaminated(documents, benchmark.limit(0)).collect())


def test_wand_finds_all_that_score_enough():
    rng = np.random.default_rng(2)
    terms = rng.integers(1, 1 << 60, 300).astype(np.uint64)
    items = [(i, rng.choice(terms, rng.integers(3, 40)), rng.choice(terms, 2)) for i in range(90)]
    index = D.Index(items, 0.35, 64, 8, 5)
    texts = [np.concatenate([q, a]) for _, q, a in items]
    for _ in range(200):
        source = texts[rng.integers(90)]
        passage = np.concatenate([rng.choice(source, rng.integers(1, len(source))), rng.choice(terms, 30)])
        places = np.unique(np.searchsorted(index.terms, passage[np.isin(passage, index.terms)]))
        scores = np.zeros(90)
        for place in places:
            scores[index.postings[place].items] += index.postings[place].weights
        expected = np.flatnonzero(scores >= 0.35 - 1e-9).tolist()
        assert sorted(index.retrieve(places, list(range(12)))) == expected
        own = places[index.essential[places]]
        blocks = index.promising(own, np.zeros(len(own), int), 1).get(0, [])
        assert {part // 8 for part in expected} <= set(blocks)
        assert sorted(index.retrieve(places, blocks)) == expected


def test_windows_are_equal_exactly_where_the_words_are():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 4, 400).astype(np.uint64)
    for size in (1, 2, 3, 5, 7, 8):
        rolled = windows(values, size)
        texts = [tuple(values[i:i + size]) for i in range(400 - size + 1)]
        assert len(rolled) == len(texts)
        assert len(set(zip(rolled.tolist(), texts))) == len(set(texts)) == len(set(rolled.tolist()))
    assert len(windows(values[:3], 5)) == 0 and len(shingle_set(values[:3], 5)) == 1


def unbalanced(spark):
    """Common words in some items, rare ones in others, and documents with parts of them."""
    draw = random.Random(8)
    common = [f"c{n}" for n in range(40)]
    items = [(n, " ".join(draw.choice(common) if n % 3 else f"r{draw.randrange(4000)}" for _ in range(
        draw.randrange(8, 200))) + ". " + " ".join(draw.choices(common, k=5)) + ".") for n in range(60)]
    texts = []
    for n, value in items:
        own = value.split()
        start = draw.randrange(0, len(own) // 2)
        texts.append(" ".join(draw.choices(common, k=90) + own[start:start + draw.randrange(4, len(own))] + own[-5:]))
    return (spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
            spark.createDataFrame(items, "item_id long, text string"))


def test_shards_do_not_change_what_is_found(spark):
    documents, benchmark = unbalanced(spark)
    found = [sorted(map(str, D.contaminated(documents, benchmark, shard_items=n).collect())) for n in (20_000, 7, 25)]
    assert found[0] == found[1] == found[2]


def test_statistics_are_those_of_all_parts(spark):
    _, benchmark = unbalanced(spark)
    parts = D.item_parts(benchmark, "item_id", "text", None, None)
    count, mean, frequency = D.statistics_of(parts, 16)
    rows = [(r.item_id, np.array(r.question, np.int64).view(np.uint64), np.array(r.answer, np.int64).view(np.uint64))
            for r in parts.collect()]
    texts = [whole[at:at + 16] for whole in (np.concatenate(r[1:]) for r in rows) for at in range(0, len(whole), 16)]
    assert (count, mean) == (len(texts), np.mean([len(t) for t in texts]))
    known = {np.int64(r.term).view(np.uint64): r.n for r in frequency.collect()}
    assert known == {t: sum(t in own for own in map(set, texts)) for t in set(np.concatenate(texts))}


def test_a_question_far_from_its_answer_is_found(spark):
    question = [f"q{n}" for n in range(20)]
    value = " ".join(question) + "? " + " ".join(f"a{n}" for n in range(20)) + "."
    filler = " ".join(f"f{n}" for n in range(400))
    documents = spark.createDataFrame([(1, " ".join(question[8:]) + " " + filler + " " + value.split("? ")[1]),
                                       (2, " ".join(question[14:]) + " " + filler + " " + value.split("? ")[1])],
                                      "doc_id long, text string")
    benchmark = spark.createDataFrame([(5, value), (6, "other words here? yes.")], "item_id long, text string")
    assert {r.doc_id: r["items"] for r in D.contaminated(
        documents, benchmark, questions=True).collect()} == {1: [5], 2: []}
