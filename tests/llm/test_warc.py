import hashlib
import random

import pytest
import zstandard

from flowtables.llm import warc
from flowtables.llm.queries import op2_warc

SCHEMA = "page_id long, url string, html string, record_type int, payload string"


def expected(rows):
    first = {}
    for page, _, html, *_ in rows:
        payload = (html or "").encode()
        if len(payload) >= 100 and page is not None:
            first[payload] = min(page, first.get(payload, page))
    found = []
    for page, url, html, *_ in rows:
        payload = (html or "").encode()
        target = first.get(payload)
        again = target is not None and target != page
        found.append((page, url, "revisit" if again else "response", target if again else None,
                      len(payload), hashlib.sha256(payload).hexdigest()))
    return sorted(found, key=str)


def archived(spark, rows, folder, **options):
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), folder, **options)
    return warc.read_archives(spark, folder)


def facts(df):
    return sorted([(r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes,
                    r.payload_digest) for r in df.collect()], key=str)


def sample_rows():
    random.seed(5)
    words = ["alpha", "beta", "été", "\r\n\r\n", "WARC/1.1", "(﻿)"]
    texts = [" ".join(random.choices(words, k=k)) for k in (0, 3, 40, 41, 300, 5000)]
    texts += [None, "", "x" * 99, "x" * 100, "é" * 50, "\x00" * 200]
    rows = [(i, f"http://h/{i}?q=ü\n", random.choice(texts), 1, "other") for i in range(150)]
    return rows + rows[:5] + [(None, None, "x" * 100, 1, None), (None, "u", None, 1, None)]


def test_round_trip_with_revisits(spark, fresh):
    rows = sample_rows()
    df = archived(spark, rows, fresh("a"), archive_bytes=20_000)
    assert facts(df) == expected(rows)
    payloads = {(r.page_id, r.payload) for r in df.where("record_type = 'response'").collect()}
    assert all((page, (html or "").encode()) in payloads for page, _, html, *_ in rows
               if len((html or "").encode()) < 100)


def test_any_zstandard_reader_finds_dictionary_and_records(spark, fresh, tmp_path):
    archived(spark, sample_rows(), fresh("a"))
    for path in tmp_path.glob("a/part-*"):
        data = path.read_bytes()
        size = int.from_bytes(data[4:8], "little")
        assert data[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little") and size
        reader = zstandard.ZstdDecompressor(
            dict_data=zstandard.ZstdCompressionDict(data[8:8 + size])
        ).stream_reader(data[8 + size:], read_across_frames=True)
        assert reader.read().count(b"WARC-Record-ID: ") > 0


def test_records_longer_than_a_feed(spark, fresh):
    random.seed(1)
    rows = [(i, "u", "".join(random.choices("abcdefgh", k=200_000)), 1, None) for i in range(3)]
    assert facts(archived(spark, rows, fresh("a"))) == expected(rows)


def test_empty_table_and_one_tiny_page(spark, fresh, tmp_path):
    (tmp_path / "none").mkdir()
    assert facts(archived(spark, [], fresh("none"))) == []
    rows = [(7, None, None, 1, None)]
    assert facts(archived(spark, rows, fresh("one"))) == expected(rows)


def test_a_broken_archive_is_an_error(spark):
    compressed = zstandard.ZstdCompressor().compress(b"WARC/1.1\r\n" * 50)
    with pytest.raises(ValueError):
        list(warc.frames(compressed[:-3]))
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1 200 OK\r\n\r\n")


def test_the_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    found = op2_warc(spark, str(tmp_path))
    assert found.collect() == [] and found.columns == ["page_id", "payload_bytes", "payload_digest",
                                                       "record_type", "refers_to"]


def test_the_sample_holds_no_copies(spark, fresh, monkeypatch):
    seen = []
    train = warc.trained
    monkeypatch.setattr(warc, "trained", lambda rows, *options: seen.append(rows.collect()) or train(rows, *options))
    rows = [(i, "u", "same words " * 40 if i % 3 else f"page {i} " * 50, 1, None) for i in range(300)]
    df = archived(spark, rows + [(None, "u", "null id " * 30, 1, None)], fresh("a"), sample_bytes=1 << 20)
    payloads = [r.payload for r in seen[0]]
    assert len(payloads) == len(set(payloads)) == 102
    assert facts(df) == expected(rows + [(None, "u", "null id " * 30, 1, None)])
