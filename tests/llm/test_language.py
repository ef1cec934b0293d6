import zlib

import numpy as np

from flowtables.llm import language


def brute(text, size=3):
    data = text.lower().encode()
    return {data[i:i + n] for n in range(1, size + 1) for i in range(len(data) - n + 1)}


def test_kernel_against_sets(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(30).collect()]
    texts += ["a", "ab", "É!", "x" * 5]
    model = language.fit([(t, "en" if i % 2 else "de") for i, t in enumerate(texts[:20])], 6, 1.0)
    marks = [t for i, t in enumerate(texts[:20]) if not i % 2][:3] + [
        t for i, t in enumerate(texts[:20]) if i % 2][:3]
    expected = [[len(brute(a) & brute(b)) / np.sqrt(len(brute(a)) * len(brute(b)))
                 for b in marks] for a in texts]
    assert np.allclose(model.kernel(texts), expected)


def test_blocks_do_not_change_the_grams(monkeypatch):
    text = "Ein längerer Text, der in Blöcke zerlegt wird. " * 20
    whole = set(language.Grams().of(text).tolist())
    monkeypatch.setattr(language, "BLOCK", 7)
    assert set(language.Grams().of(text).tolist()) == whole
    assert len(whole) == len(brute(text))


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(documents).collect()
    assert len(rows) == documents.count()
    tested = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in tested) / len(tested) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_teach_nothing(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    changed = documents.selectExpr("doc_id", "text", "source", "n_chars",
                                   "if(crc32(cast(doc_id as string)) % 3 = 1, 'xx', lang) AS lang")
    found = [{r.doc_id: (r.lang_pred, r.score) for r in language.identify(df).collect()}
             for df in (documents, changed)]
    assert found[0] == found[1]


def test_odd_tables(spark):
    rows = [(1, "the words and the", "en", "s", 0.5), (2, "die wörter und der", "de", "s", 0.5),
            (3, None, "en", "s", 0.5), (4, "", None, "s", 0.5), (5, "12 !? 34", "en", "s", 0.5),
            (None, "the the", "en", "s", 0.5), (4, "the words " * 40_000, None, "s", 0.5)] * 2
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, s string, score double")
    found = {(r.doc_id, (r.text or "")[:5]): r for r in language.identify(table).collect()}
    assert [found[k].lang_pred for k in ((3, ""), (4, ""), (5, "12 !?"))] == ["und"] * 3
    assert found[1, "the w"].lang_pred in ("en", "de") and not found[None, "the t"].held_out
    unlabelled = language.identify(table.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    assert language.identify(table.limit(0)).count() == 0


def worded(language, number, words=60):
    """Text of a made-up language: its own syllables."""
    draw = np.random.default_rng(1000 * language + number)
    syllables = ["".join(chr(97 + (7 * language + 3 * k + j * (language % 11 + 1)) % 26) for j in range(3))
                 for k in range(8)]
    return " ".join("".join(draw.choice(syllables, 2)) for _ in range(words))


def test_a_language_seen_only_in_long_texts_is_learned(spark):
    rows = [(n, worded(1, n), "en") for n in range(60)] + [
        (100 + n, worded(2, n, 13_000), "de") for n in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify(table).collect()
    assert min(len(r.text) for r in found if r.lang == "de") > 64 << 10
    assert all(r.lang_pred == r.lang for r in found)


def test_more_than_two_hundred_languages_are_learned(spark):
    rows = [(3 * n + i, worded(n, i), f"l{n:03d}") for n in range(201) for i in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(table)
    assert len(model.languages) == 201
    names, _ = model.predict([worded(n, 77) for n in range(201)])
    assert sum(name == f"l{n:03d}" for n, name in enumerate(names)) > 150


def test_the_sample_is_bounded_in_bytes_and_languages_take_turns(spark):
    rows = [(n, worded(n % 3, n), "abc"[n % 3]) for n in range(90)] + [(200, worded(7, 1), "rare")]
    table = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string")
    drawn = language.drawn_rows(table, "text", "lang", "doc_id", 400, 6000, 64 << 10).collect()
    counts = {name: sum(r.lang == name for r in drawn) for name in ("a", "b", "c", "rare")}
    assert counts["rare"] == 1 and len({counts[k] for k in "abc"}) == 1 and 1 < counts["a"] < 30
    few = language.drawn_rows(table, "text", "lang", "doc_id", 400, 500, 64 << 10).collect()
    assert [r.rank for r in few] == [1] * len(few) and 1 <= len(few) < 4
    assert len(language.drawn_rows(table, "text", "lang", "doc_id", 5, 1 << 20, 64 << 10).collect()) == 16


def test_letters_are_told_without_a_model(spark):
    rows = [(1, "words"), (2, "12 !?"), (3, None), (4, ""), (5, "é")]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "cast(null as string) AS lang")
    found = {r.doc_id: (r.lang_pred, r.has_letters) for r in language.identify(table).collect()}
    assert found == {1: ("und", True), 2: ("und", False), 3: ("und", False), 4: ("und", False), 5: ("und", True)}
