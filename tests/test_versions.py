"""Versioned tables, change logs in levels, and the tables that streams keep with them."""

import threading
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_streams import SCHEMA, START, feed, minutes, stream, table

from flowtables.operators import aggregates as A
from flowtables.operators import windows as W
from flowtables.streaming import changes as C
from flowtables.streaming import versions as V
from flowtables.streaming import windows as SW
from flowtables.streaming.runs import EndMarker, append_rows

ROWS = T.StructType([T.StructField("k", T.StringType()), T.StructField("ts", T.TimestampType()),
                     T.StructField("v", T.LongType())])
NUMBERS = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType())])


def numbers(spark, first, last, value):
    return spark.range(first, last).select(F.col("id").alias("k"), F.lit(value).cast("long").alias("v"))


def test_a_reader_in_a_loop_never_fails_and_sees_no_mixture(spark, fresh):
    folder = fresh("table")
    V.replace_version(numbers(spark, 0, 500, 0), folder)
    seen, failures, done = set(), [], threading.Event()

    def read():
        while not done.is_set():
            try:
                seen.add(tuple(V.read_version(spark, folder, NUMBERS).agg(
                    F.count("k"), F.min("v"), F.max("v")).first()))
            except Exception as failure:  # noqa: BLE001
                failures.append(failure)

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for value in range(1, 6):
            V.replace_version(numbers(spark, 0, 500 + value, value).repartition(3), folder)
    finally:
        done.set()
        reader.join()
    assert not failures
    assert seen <= {(500 + v, v, v) for v in range(6)} and (505, 5, 5) in seen | {
        tuple(V.read_version(spark, folder, NUMBERS).agg(F.count("k"), F.min("v"), F.max("v")).first())}


def test_commits_do_not_overwrite_each_other_and_old_parts_go(spark, fresh):
    t = V.VersionedTable(spark, fresh("table"), keep=2)
    assert t.current() == V.Version() and t.read(NUMBERS, ()).count() == 0
    first = t.commit(V.Version(), (t.write(numbers(spark, 0, 3, 1)),), note="a")
    with pytest.raises(V.Conflict):
        t.commit(V.Version(), (), note="b")
    assert t.current() == first and first.notes == {"note": "a"}
    pinned = t.read(NUMBERS, first.parts)
    second = t.commit(first, (t.write(numbers(spark, 0, 4, 2)),))
    assert pinned.count() == 3
    t.commit(second, (*second.parts, t.write(numbers(spark, 9, 10, 3))))
    with pytest.raises(Exception, match="(?i)exist"):
        t.read(NUMBERS, first.parts).count()
    assert t.read(NUMBERS, t.current().parts).count() == 5


def test_a_stream_is_replaced_after_its_successor_is_filled(spark, fresh):
    feed(spark, fresh("in"), [("a", 0, 1), ("b", 1, 2)])

    def start(factor):
        def run(folder):
            append_rows(stream(spark, fresh("in")).select((F.col("v") * factor).alias("k"), "v"), folder)
        return run

    V.replace_stream(start(10), spark, fresh("relation"))
    before = V.read_version(spark, fresh("relation"), NUMBERS)
    V.replace_stream(start(100), spark, fresh("relation"))
    assert table(before) == [(10, 1), (20, 2)]
    assert table(V.read_version(spark, fresh("relation"), NUMBERS)) == [(100, 1), (200, 2)]


def test_log_levels_grow_with_the_logarithm_of_the_batches(spark, fresh):
    log = C.TableLog(spark, fresh("log"), NUMBERS, ["k"], fanout=2)
    version, expected = log.versions.current(), {}
    for batch in range(16):
        puts = numbers(spark, batch, batch + 3, batch).withColumn("_deleted", F.col("k") == batch)
        version = log.append(version, batch, puts)
        expected.update({batch + 1: batch, batch + 2: batch})
        expected.pop(batch, None)
        assert table(log.table()) == sorted(expected.items(), key=str)
        assert len(version.of("log")) <= 5
    assert [part.level for part in version.of("log")] == [4]
    assert log.changes().where("_deleted").count() == 0  # nothing is left for deletes to act on


def counts():
    return [A.count_rows("n"), A.total("total", F.col("v")), A.latest("last", F.col("v"), F.col("ts"))]


def session_table(spark, fresh, grace="100 HOURS"):
    return SW.SessionTable(spark, fresh("sessions"), ROWS, "ts", W.session("10 MINUTES", grace=grace),
                           ["k"], counts())


def test_sessions_equal_the_batch_after_every_batch(spark, fresh):
    t = session_table(spark, fresh)
    batches = [[("a", 0, 1), ("a", 25, 2), (None, 5, 3), ("b", 0, 9)],
               [("a", 12, 4), ("a", 40, 5)],             # neither touches what is there
               [("a", 18, 6), (None, 15, 7)],            # bridges 12 and 25; null keys are a key
               [("a", 8, 8), ("b", 100, 1), ("a", -9, 2)],  # bridges all, starts earlier
               [("c", 1, None)]]
    rows = []
    for number, batch in enumerate(batches):
        feed(spark, fresh("in"), batch)
        t.run(stream(spark, fresh("in")))
        rows += [(k, START + timedelta(minutes=m), v) for k, m, v in batch]
        expected = W.window_agg(spark.createDataFrame(rows, SCHEMA), "ts", W.session("10 MINUTES"), ["k"], counts())
        assert table(t.table().select(expected.columns)) == table(expected), number
        if number == 2:  # the session that was swallowed is a delete in the log
            assert minutes(t.log.changes().where("_deleted"), "k") == [(25, "a")]
    assert t.open_sessions().count() == t.table().count()


def test_session_state_is_bounded_and_late_rows_are_dropped(spark, fresh):
    t = session_table(spark, fresh, grace="0 SECONDS")
    for batch in ([("a", 0, 1), ("b", 5, 1)], [("a", 100, 1)],
                  [("a", 3, 5), ("a", 95, 7), ("b", 89, 1)]):
        feed(spark, fresh("in"), batch)
        t.run(stream(spark, fresh("in")))
    # 3 is late: its session would have ended at 13, long before 100; 95 is not and joins 100.
    assert minutes(t.table(), "k", "n", "total") == [(0, "a", 1, 1), (5, "b", 1, 1), (95, "a", 2, 8)]
    assert [r.k for r in t.open_sessions().collect()] == ["a"]


def test_a_batch_that_runs_again_changes_nothing(spark, fresh):
    t = session_table(spark, fresh)
    batch = spark.createDataFrame([("a", START, 1)], SCHEMA)
    for _ in range(2):
        t.update(batch, 0)
    assert minutes(t.table(), "n") == [(0, 1)]
    assert t.log.versions.current().number == 1


def test_having_deletes_groups_that_stop_matching(spark, fresh):
    expected = []
    log = C.TableLog(spark, fresh("having"), T.StructType.fromDDL("k string, n bigint"), ["k"])
    for batch, now in (([("a", 0, 1), ("b", 0, 1), ("c", 0, 1), ("c", 1, 1)], {"a": 1, "b": 1}),
                       ([("a", 1, 1), (None, 0, 1)], {"b": 1, None: 1}),
                       ([("c", 2, 1), (None, 0, 1)], {"b": 1}), ([("d", 0, 1)], {"b": 1, "d": 1})):
        feed(spark, fresh("in"), batch)
        groups = stream(spark, fresh("in")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        C.matching_changes(groups, F.col("n") == 1, log)
        expected.append(now)
        assert dict(table(log.table())) == now
    # One delete for each group that stopped matching, none for c, which never matched.
    assert sorted((r.k or "", r.batch_id) for r in log.changes().where("_deleted").collect()) in (
        [("", 2), ("a", 1)], [])
    assert log.versions.current().notes["batch_id"] == 3


def test_first_rows_are_put_once(spark, fresh):
    log = C.TableLog(spark, fresh("first"), ROWS, ["k"])
    for batch in ([("a", 5, 1), ("a", 3, 2), (None, 9, 3)], [("a", 1, 4), ("b", 8, 5)], [(None, 0, 6), ("b", 9, 7)]):
        feed(spark, fresh("in"), batch)
        C.first_only(stream(spark, fresh("in")), "ts", log)
    found = sorted(((r.k or "", r.v, r.batch_id) for r in log.changes().collect()))
    assert found == [("", 3, 0), ("a", 2, 0), ("b", 5, 1)]


def test_panes_equal_one_step_windows_with_less_state(spark, fresh):
    window = W.hopping("60 MINUTES", "5 MINUTES", grace="30 MINUTES")
    batches = [[("a", m, m) for m in range(0, 60)], [("b", m, 1) for m in range(40, 90, 3)], [("a", 100, None)]]
    folder = fresh("in")
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    marker = EndMarker(spark, ROWS, "ts", fresh("marker"))
    states = {}
    rows = [row for batch in batches for row in batch]
    for name in ("panes", "steps"):
        marked = EndMarker(spark, ROWS, "ts", fresh(f"marker-{name}"))
        source = marked.attach(stream(spark, folder))
        make = SW.pane_windows if name == "panes" else W.window_agg
        sink = fresh(name)
        df = make(source, "ts", window, ["k"], counts())
        for batch in batches:
            if name == "panes":
                feed(spark, folder, batch)
        query = append_rows(df, sink)
        states[name] = max(sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress)
        marked.close()
        append_rows(df, sink)
    data = spark.createDataFrame([(k, START + timedelta(minutes=m), v) for k, m, v in rows], SCHEMA)
    expected = W.window_agg(data, "ts", W.hopping("60 MINUTES", "5 MINUTES"), ["k"], counts())
    for name in ("panes", "steps"):
        assert table(spark.read.parquet(fresh(name)).select(expected.columns)) == table(expected)
    assert states["panes"] < states["steps"]
    assert marker


def window_table(spark, fresh, **options):
    return SW.WindowTable(spark, fresh("windows"), ROWS, "ts", W.tumbling("10 MINUTES", **options), ["k"],
                          counts(), period="1 HOUR")


def test_strict_grace_drops_a_row_in_the_batch_in_which_it_is_late(spark, fresh):
    for batch in ([("a", 0, 1)], [("a", 100, 2), ("a", 5, 3)], [("a", 9, 4), ("a", 71, 5), ("a", 69, 6)],
                  [("b", 75, 7)]):
        feed(spark, fresh("in"), batch)
        # A new object each time, as after a restart: the watermark comes from the commit.
        window_table(spark, fresh, grace="20 MINUTES").run(stream(spark, fresh("in")))
    # Watermark 80 after the second batch: windows that end at 80 or before take no more rows.
    found = window_table(spark, fresh, grace="20 MINUTES").table()
    assert minutes(found, "k", "n", "total") == [(0, "a", 2, 4), (100, "a", 1, 2)]


def test_retention_drops_periods_and_refuses_what_is_past_it(spark, fresh):
    t = window_table(spark, fresh, grace="100 HOURS", retention="2 HOURS")
    counts = []
    for hour in range(12):
        feed(spark, fresh("in"), [("a", 60 * hour + m, 1) for m in (0, 15, 30)] + [("late", 5, 1)] * (hour > 3))
        t.run(stream(spark, fresh("in")))
        counts.append(len({part.period for part in t.parts()}))
    assert max(counts) <= 4 and {part.period for part in t.parts()} and not any(
        r.k == "late" for r in t.table().collect())
    newest = 60 * 11 + 30
    assert minutes(t.table(), "k", "n") == sorted(
        [(m // 10 * 10, "a", 1) for h in range(12) for m in (60 * h, 60 * h + 15, 60 * h + 30)
         if m // 10 * 10 + 10 > newest - 120], key=str)


def test_windows_equal_the_batch_over_many_batches(spark, fresh):
    t = SW.WindowTable(spark, fresh("windows"), ROWS, "ts", W.hopping("20 MINUTES", "5 MINUTES", grace="100 HOURS"),
                       ["k"], counts(), period="1 HOUR")
    rows = []
    for n in range(9):
        batch = [("a", 7 * n, n), ("b", 60 - 5 * n, None), (None, n, 2)]
        feed(spark, fresh("in"), batch)
        t.run(stream(spark, fresh("in")))
        rows += [(k, START + timedelta(minutes=m), v) for k, m, v in batch]
    expected = W.window_agg(spark.createDataFrame(rows, SCHEMA), "ts", W.hopping("20 MINUTES", "5 MINUTES"),
                            ["k"], counts())
    assert table(t.table().select(expected.columns)) == table(expected)
    assert all(sum(p.period == q.period and p.level == q.level for q in t.parts()) < 4 for p in t.parts())


def test_reduced_logs_equal_the_whole(spark, fresh):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    logs = {d: C.ReducedLog(spark, fresh(f"top-{d}"), schema, C.largest(["k"], "v", 3, d), fanout=2)
            for d in (False, True)}
    first = C.ReducedLog(spark, fresh("first"), schema, lambda rows: A.first_occurrence(rows, ["k"], "v"))
    rows = []
    for number in range(7):
        batch = [("a", n * number % 11) for n in range(5)] + [("b" if number % 2 else None, 50 - number)]
        rows += batch
        for log in (*logs.values(), first):
            for _ in range(2):  # the second time it is known already
                log.update(spark.createDataFrame(batch, schema), number)
        for distinct, log in logs.items():
            expected = [(k, v) for k in {k for k, _ in rows} for v in sorted(
                (set if distinct else list)(v for key, v in rows if key == k), reverse=True)[:3]]
            assert table(log.table()) == sorted(expected, key=str)
            assert len(log.versions.current().parts) <= 4
    assert table(first.table()) == sorted(((k, min(v for key, v in rows if key == k)) for k in {k for k, _ in rows}), key=str)
