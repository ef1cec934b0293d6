import contextlib
import shutil
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowtables.functions.schemas import declare
from flowtables.operators import aggregates as A
from flowtables.operators import windows as W
from flowtables.operators.tables import latest_per_key
from flowtables.sources.tables import stream_table
from flowtables.sources.topics import (
    OffsetTopic, declare_source, folder_records, kafka_records, merged, to_records, write_folder_topic,
)
from flowtables.streaming import operators as S
from flowtables.streaming.runs import (
    EndMarker, append_changes, append_rows, current_table, read_changes, write_snapshot,
)

START = datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp, v bigint"


def feed(spark, folder, data):
    """Append one file of (key, minute, value) rows to a folder."""
    rows = [(k, START + timedelta(minutes=m), v) for k, m, v in data]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, **options):
    Path(folder).mkdir(exist_ok=True)
    return spark.readStream.schema(SCHEMA).options(**options).parquet(folder)


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def minutes(df, *names):
    return sorted(((int((r["window_start"] - START).total_seconds() // 60),
                    *[r[n] for n in names]) for r in df.collect()), key=str)


def test_json_topic_with_event_time(spark, fresh):
    schema = declare("id bigint, timestamp bigint, o struct<total double>, tags array<varchar>",
                     key="id")
    data = spark.createDataFrame([(1, 1704067200123, (2.5,), ["x"]), (2, None, None, None)],
                                 schema.simpleString())
    write_folder_topic(data, fresh("topic"))
    for is_stream in (False, True):
        rows = declare_source(folder_records(spark, fresh("topic"), stream=is_stream), schema,
                              event_time="timestamp")
        if is_stream:
            append_rows(rows, fresh("sink"))
            rows = spark.read.parquet(fresh("sink"))
        assert table(rows.select("id", "ts", "o.total", F.col("tags")[0])) == [
            (1, datetime(2024, 1, 1, 0, 0, 0, 123000), 2.5, "x"), (2, None, None, None)]


def test_text_event_time(spark):
    records = spark.createDataFrame([('{"t": "2024-01-01 00:01"}',), ('{"t": "?"}',)], "value string")
    rows = declare_source(records, declare("t varchar"), "t", pattern="yyyy-MM-dd HH:mm")
    assert [r["ts"] for r in rows.collect()] == [datetime(2024, 1, 1, 0, 1), None]


def test_record_keys(spark):
    df = spark.createDataFrame([(1, "a")], "id bigint, k string")
    assert to_records(df, ["k"]).first()["key"] == "a"
    assert to_records(df, ["id", "k"]).first().asDict() == {
        "key": '{"id":1,"k":"a"}', "value": '{"id":1,"k":"a"}'}


def test_kafka_needs_its_module_and_a_known_start(spark):
    with pytest.raises(RuntimeError, match="spark-sql-kafka"):
        kafka_records(spark, "broker:9092", "t")
    with pytest.raises(ValueError):
        kafka_records(spark, "broker:9092", "t", start="none")


def test_fan_in_of_different_columns(spark, fresh):
    feed(spark, fresh("in"), [("a", 0, 1), ("b", 1, 2)])
    one = stream(spark, fresh("in")).where("k = 'a'").select("k", "v")
    two = stream(spark, fresh("in")).where("k = 'b'").select("k", "ts")
    append_rows(merged(one, two), fresh("out"))
    assert table(spark.read.parquet(fresh("out")).select("k", "v")) == [("a", 1), ("b", None)]


AGGREGATED = [("hopping", W.hopping("20 MINUTES", "10 MINUTES")), ("tumbling", W.tumbling("5 MINUTES"))]


@pytest.mark.parametrize("name, window", AGGREGATED)
def test_update_mode_over_batches_equals_batch(spark, fresh, name, window):
    batches = [[("a", 0, 1), ("b", 3, 2), (None, 4, 3)], [("a", 12, 4), ("a", 13, 5)], [("b", 40, 6)]]
    aggs = [A.count_rows("n"), A.total("t", F.col("v")), A.latest("l", F.col("v"), F.col("v"))]
    for batch in batches:
        feed(spark, fresh("in"), batch)
        counted = W.window_agg(stream(spark, fresh("in")), "ts", window, ["k"], aggs)
        append_changes(counted, fresh("log"))
    changes = read_changes(spark, fresh("log"), counted.schema)
    current = current_table(changes, [*W.BOUNDS, "k"])
    whole = W.window_agg(spark.read.schema(SCHEMA).parquet(fresh("in")), "ts", window, ["k"], aggs)
    assert table(current.select(whole.columns)) == table(whole)


def test_sessions_close_in_append_mode(spark, fresh):
    window = W.session("20 MINUTES")
    reader = stream(spark, fresh("in"))
    marker = EndMarker(spark, reader.schema, "ts", fresh("marker"))
    found = W.window_agg(marker.attach(reader), "ts", window, ["k"], [A.count_rows("n")])
    for batch in ([("a", 0, 1), ("a", 20, 2), ("b", 5, 3)], [("a", 50, 4), ("c", 51, 5)]):
        feed(spark, fresh("in"), batch)
        append_rows(found, fresh("out"))
    before = minutes(spark.read.parquet(fresh("out")), "k", "n")
    marker.close()
    append_rows(found, fresh("out"))
    after = spark.read.parquet(fresh("out"))
    assert before == [(0, "a", 2), (5, "b", 1)]
    assert minutes(after, "k", "n") == [(0, "a", 2), (5, "b", 1), (50, "a", 1), (51, "c", 1)]
    whole = W.window_agg(spark.read.schema(SCHEMA).parquet(fresh("in")), "ts", window, ["k"],
                         [A.count_rows("n")])
    assert table(after) == table(whole)


@pytest.mark.parametrize("grace, kept", [("0 SECONDS", False), ("2 HOURS", True)])
def test_late_rows_two_batches_after_the_jump(spark, fresh, grace, kept):
    reader = stream(spark, fresh("in"), maxFilesPerTrigger="1")
    counted = W.window_agg(reader, "ts", W.tumbling("10 MINUTES", grace=grace), [],
                           [A.count_rows("n")])
    # The second batch moves the watermark; the third and fourth bring late rows.
    for batch in ([("a", 0, 1)], [("a", 60, 2)], [("late", 1, 3)], [("late", 2, 4)]):
        feed(spark, fresh("in"), batch)
        append_changes(counted, fresh("log"))
    changes = read_changes(spark, fresh("log"), counted.schema)
    current = current_table(changes, [*W.BOUNDS])
    assert minutes(current, "n") == ([(0, 3), (60, 1)] if kept else [(0, 1), (60, 1)])


def test_exact_distinct_count_of_a_stream(spark, fresh):
    window = W.tumbling("10 MINUTES", grace="1 HOUR")
    for batch in ([("a", 0, 1), ("a", 1, 1), ("a", 2, 2)], [("a", 3, 1), ("b", 4, None)]):
        feed(spark, fresh("in"), batch)
        seen = W.distinct_per_window(stream(spark, fresh("in")), "ts", window, ["k"], "v")
        append_rows(seen, fresh("seen"))
    counted = spark.read.parquet(fresh("seen")).groupBy("window_start", "k").count()
    assert minutes(counted, "k", "count") == [(0, "a", 2)]


def test_keyed_table_follows_its_changes(spark, fresh):
    for batch in ([("a", 0, 1), ("b", 1, 2)], [("a", 2, 3)]):
        feed(spark, fresh("in"), batch)
        append_changes(latest_per_key(stream(spark, fresh("in")), ["k"], F.col("ts")), fresh("log"))
    changes = read_changes(spark, fresh("log"), stream(spark, fresh("in")).schema)
    assert changes.count() == 3
    assert table(current_table(changes, ["k"]).select("k", "v")) == [("a", 3), ("b", 2)]


def test_snapshots_replace_the_log_before_them(spark, fresh):
    table_rows, snapshot = None, None
    for n, batch in enumerate([[("a", 0, 1), ("b", 1, 2)], [("a", 2, 3)], [("c", 3, 4)]]):
        feed(spark, fresh("in"), batch)
        newest = latest_per_key(stream(spark, fresh("in")), ["k"], F.col("ts"))
        append_changes(newest, fresh("log"))
        changes = read_changes(spark, fresh("log"), newest.schema)
        table_rows = table(current_table(changes, ["k"], snapshot).select("k", "v"))
        assert table_rows == table(current_table(changes, ["k"]).select("k", "v"))
        write_snapshot(changes, ["k"], fresh(f"snapshot{n}"), snapshot)
        snapshot = spark.read.parquet(fresh(f"snapshot{n}"))
    assert table_rows == [("a", 3), ("b", 2), ("c", 4)]


def test_changes_read_back_as_a_stream(spark, fresh):
    for batch in ([("a", 0, 1)], [("a", 1, 5), ("b", 2, 1)]):
        feed(spark, fresh("in"), batch)
        totals = stream(spark, fresh("in")).groupBy("k").agg(F.sum("v").alias("t"))
        append_changes(totals, fresh("log"))
        changes = read_changes(spark, fresh("log"), totals.schema, stream=True)
        append_rows(changes.where("t > 0"), fresh("reread"))
    reread = spark.read.parquet(fresh("reread"))
    assert table(reread.select("k", "t")) == [("a", 1), ("a", 6), ("b", 1)]


def test_stateless_topk(spark, fresh):
    for batch in ([("a", 0, 1), ("a", 0, 9), ("a", 0, 5), ("n", 0, None)], [("a", 0, 9), ("b", 0, 2)]):
        feed(spark, fresh("in"), batch)
        S.topk_changes(stream(spark, fresh("in")), fresh("log"), ["k"], F.col("v"), 2, "top")
    schema = spark.createDataFrame([], "k string, top array<bigint>").schema
    changes = read_changes(spark, fresh("log"), schema)
    assert table(S.topk_table(changes, ["k"], 2, "top")) == [("a", [9, 9]), ("b", [2]), ("n", [])]


def test_first_rows_are_never_forgotten(spark, fresh):
    """A key's rows are days apart, and the first one arrives last."""
    for batch in ([("a", 9000, 5), ("a", 1, 2)], [("a", 20000, 3), ("b", 3, 4)], [("a", 40000, 1)]):
        feed(spark, fresh("in"), batch)
        S.first_changes(stream(spark, fresh("in")), fresh("log"), ["k"], "v")
    changes = read_changes(spark, fresh("log"), stream(spark, fresh("in")).schema)
    assert table(S.first_table(changes, ["k"], "v").select("k", "v")) == [("a", 1), ("b", 4)]


def test_a_table_folder_is_streamed_like_a_table_file(spark, fresh):
    rows = spark.range(100).select(F.col("id").alias("event_id"))
    rows.repartition(4).write.parquet(fresh("events.parquet"))
    folder = str(Path(fresh("events.parquet")).parent)
    append_rows(stream_table(spark, folder, "events", maxFilesPerTrigger="1"), fresh("out"))
    assert spark.read.parquet(fresh("out")).count() == 100
    rows.limit(0).write.parquet(fresh("none.parquet"))
    with pytest.raises(ValueError, match="no files") if not spark.read.parquet(
            fresh("none.parquet")).inputFiles() else contextlib.nullcontext():
        stream_table(spark, folder, "none")


def test_changes_after_an_empty_snapshot(spark, fresh):
    feed(spark, fresh("in"), [("a", 0, 1), ("b", 1, 2)])
    newest = latest_per_key(stream(spark, fresh("in")), ["k"], F.col("ts"))
    append_changes(newest, fresh("log"))
    changes = read_changes(spark, fresh("log"), newest.schema)
    empty = changes.limit(0)
    assert table(current_table(changes, ["k"], empty).select("k", "v")) == [("a", 1), ("b", 2)]


def test_a_retention_on_a_stream_is_refused(spark, fresh):
    window = W.tumbling("1 MINUTE", retention="2 MINUTES")
    with pytest.raises(ValueError, match="retained"):
        W.window_agg(stream(spark, fresh("in")), "ts", window, ["k"], [A.count_rows("n")])


def test_delimited_topics_keep_line_breaks_and_empty_texts(spark, fresh):
    data = [(1, "a\nb"), (2, ""), (3, None), (4, 'x,"y"\r'), (5, "%0A%N"), (6, " %")]
    df = spark.createDataFrame(data, "id bigint, v string")
    write_folder_topic(df, fresh("topic"), value_format="DELIMITED")
    back = declare_source(folder_records(spark, fresh("topic"), stream=False), df.schema,
                          value_format="DELIMITED")
    assert table(back) == table(df)


def test_keyed_folder_topics_keep_their_key(spark, fresh):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, v string")
    write_folder_topic(df, fresh("topic"), keys=["id"])
    records = folder_records(spark, fresh("topic"), stream=False, keyed=True)
    assert sorted(r["key"] for r in records.collect()) == ["1", "2"]
    assert table(declare_source(records, df.schema).select("id", "v")) == table(df)


def test_upper_case_json_at_every_depth(spark):
    schema = declare("order struct<total_basket double>, tags array<struct<a int>>, m map<varchar, struct<b int>>")
    text = '{"ORDER":{"TOTAL_BASKET":2.5},"TAGS":[{"A":1}],"M":{"x":{"B":2}}}'
    row, = declare_source(spark.createDataFrame([(text,)], "value string"), schema,
                          json_case="upper").collect()
    assert (row["order"]["total_basket"], row.tags[0].a, row.m["x"].b) == (2.5, 1, 2)


def test_join_sees_the_table_as_of_each_batch(spark, fresh):
    for price, batch in ((10, [("a", 0, 1)]), (20, [("a", 1, 2), ("x", 2, 3)])):
        spark.createDataFrame([("a", price)], "k string, price int").write.mode(
            "overwrite").parquet(fresh("prices"))
        feed(spark, fresh("in"), batch)
        S.join_refreshed(stream(spark, fresh("in")).select("k", "v"),
                         lambda: spark.read.parquet(fresh("prices")), "k", fresh("log"))
    joined = spark.read.parquet(fresh("log")).select("k", "v", "price")
    assert table(joined) == [("a", 1, 10), ("a", 2, 20), ("x", 3, None)]


def test_a_repeated_batch_replaces_itself(spark, fresh):
    """What a restart after a lost driver does: the last batch is written again."""
    feed(spark, fresh("in"), [("a", 0, 1)])
    totals = stream(spark, fresh("in")).groupBy("k").count()
    append_changes(totals, fresh("log"))
    changes = read_changes(spark, fresh("log"), totals.schema, stream=True)
    append_rows(changes, fresh("reread"))
    shutil.rmtree(f"{fresh('log')}.checkpoint/commits")
    append_changes(totals, fresh("log"))
    append_rows(changes, fresh("reread"))
    assert table(read_changes(spark, fresh("log"), totals.schema)) == [("a", 1, 0)]
    assert table(spark.read.schema(changes.schema).parquet(fresh("reread"))) == [("a", 1, 0)]


def test_offsets_of_a_folder_topic(spark, fresh):
    topic = OffsetTopic(spark, fresh("topic"), 3)
    assert topic.records().count() == 0 and topic.ends() == {}
    schema = "k string, n bigint"
    topic.append(spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), (None, 9)], schema), ["k"], order=["n"])
    ends = topic.ends()
    topic.append(spark.createDataFrame([("a", 4), ("c", 0)], schema), ["k"])
    topic.append(spark.createDataFrame([], schema), ["k"])
    rows = topic.records().collect()
    for number, end in topic.ends().items():
        assert sorted(r.offset for r in rows if r.partition == number) == list(range(end))
    own = sorted((r.offset, r.value) for r in rows if r.key == "a")
    assert ["3" in v or "1" in v or "4" in v for _, v in own] == [True] * 3 and len({r.partition for r in rows if r.key == "a"}) == 1
    values = declare_source(topic.records().where("key = 'a'"), declare("k varchar, n bigint")).orderBy("offset")
    assert [r.n for r in values.collect()] == [1, 3, 4]
    # ``latest`` leaves out what is there; a stream from given offsets reads what came after them.
    assert topic.records("latest").count() == 0
    assert sorted(r.key for r in topic.records(ends).collect()) == ["a", "c"]
    append_rows(topic.records(ends, stream=True), fresh("sink"))
    topic.append(spark.createDataFrame([("d", 1)], schema), ["k"])
    append_rows(topic.records(ends, stream=True), fresh("sink"))
    assert sorted(r.key for r in spark.read.parquet(fresh("sink")).collect()) == ["a", "c", "d"]
    with pytest.raises(ValueError, match="start position"):
        topic.records("none")


def test_stream_joined_as_of_with_late_versions(spark, fresh):
    versions = [[("a", START, 10)], [("a", START + timedelta(minutes=3), 20)]]
    known = []
    for number, batch in enumerate(([("a", 1, 1), ("a", 5, 2), ("b", 1, 3)], [("a", 6, 4), ("a", 2, 5)])):
        known += versions[number]
        feed(spark, fresh("in"), batch)
        table_now = spark.createDataFrame(known, "k string, since timestamp, price bigint")
        S.join_as_of(stream(spark, fresh("in")), lambda: table_now, ["k"], "ts", "since", fresh("joined"))
    found = spark.read.parquet(fresh("joined")).select("v", "price").collect()
    # Event 2 was joined before the version of minute 3 arrived, event 4 after it.
    assert dict(found) == {1: 10, 2: 10, 3: None, 4: 20, 5: 10}


@pytest.mark.parametrize("value_format", ["JSON", "DELIMITED"])
def test_records_keep_microseconds(spark, fresh, value_format):
    at = START + timedelta(microseconds=123456)
    df = spark.createDataFrame([("a", at, 1), (None, None, None)], SCHEMA).withColumn(
        "n", F.col("ts").cast("timestamp_ntz"))
    back = declare_source(to_records(df, value_format=value_format), df.schema, value_format=value_format)
    assert table(back) == table(df) and back.where("k = 'a'").first()["n"] == at
