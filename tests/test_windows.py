from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowtables.operators import aggregates as A
from flowtables.operators import windows as W

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def rows(spark, data):
    return spark.createDataFrame([(k, at(s), s) for k, s in data],
                                 "k string, ts timestamp_ntz, v double")


def test_durations():
    assert W.duration("20 MINUTES") == timedelta(minutes=20)
    assert W.duration("1 hour") == timedelta(hours=1)
    assert W.duration("0 SECONDS") == timedelta(0)
    for bad in ("1 DAY", "1.5 HOURS", "MINUTE", "-1 MINUTE", "1 month"):
        with pytest.raises(ValueError):
            W.duration(bad)


def test_window_rules():
    for bad in (lambda: W.Window("hopping", "1 MINUTE"), lambda: W.hopping("1 MINUTE", "2 MINUTES"),
                lambda: W.hopping("1 MINUTE", "0 SECONDS"),
                lambda: W.Window("tumbling", "1 MINUTE", "1 MINUTE"),
                lambda: W.Window("sliding", "1 MINUTE"),
                lambda: W.tumbling("1 HOUR", retention="1 MINUTE")):
        with pytest.raises(ValueError):
            bad()


def spans(df, *names):
    return sorted((((r["window_start"] - START).total_seconds(),
                    (r["window_end"] - START).total_seconds(), *[r[n] for n in names])
                   for r in df.collect()), key=str)


def test_an_event_on_the_edge_belongs_to_the_later_window(spark):
    df = rows(spark, [("a", 0.0), ("a", 59.999999), ("a", 60.0)])
    counted = W.window_agg(df, "ts", W.tumbling("1 MINUTE"), ["k"], [A.count_rows("n")])
    assert spans(counted, "n") == [(0.0, 60.0, 2), (60.0, 120.0, 1)]
    hops = W.window_agg(df, "ts", W.hopping("1 MINUTE", "30 SECONDS"), ["k"], [A.count_rows("n")])
    assert spans(hops, "n") == sorted(
        [(-30.0, 30.0, 1), (0.0, 60.0, 2), (30.0, 90.0, 2), (60.0, 120.0, 1)], key=str)


def test_a_gap_of_exactly_the_limit_merges(spark):
    df = rows(spark, [("a", 0.0), ("a", 1200.0), ("b", 0.0), ("b", 1200.000001), (None, 5.0)])
    found = W.window_agg(df, "ts", W.session("20 MINUTES"), ["k"], [A.count_rows("n")])
    assert spans(found, "k", "n") == sorted([
        (0.0, 2400.0, "a", 2), (0.0, 1200.0, "b", 1), (1200.000001, 2400.000001, "b", 1),
        (5.0, 1205.0, None, 1)], key=str)


def aggs():
    value = F.col("v")
    return [A.count_rows("n"), A.total("t", value), A.smallest("lo", value),
            A.latest("last", value, value), A.earliest("first", value, value)]


def random_rows(spark):
    """A third of the rows belong to one key."""
    cold = F.concat(F.lit("k"), (F.rand(2) * 30).cast("int").cast("string"))
    key = F.when(F.rand(1) < 0.34, "hot").otherwise(cold)
    second = (F.rand(3) * 20_000).cast("int")
    return (spark.range(0, 3000, 1, 5)
            .select(key.alias("k"), (F.lit(START).cast("timestamp_ntz")
                    + F.make_dt_interval(secs=second.cast("decimal(18,6)"))).alias("ts"),
                    F.col("id").cast("double").alias("v")))


def test_sessions_equal_the_built_in_ones(spark):
    df = random_rows(spark)
    for gap in ("1 SECOND", "30 SECONDS", "7 MINUTES", "2 HOURS"):
        ours = W._sessions(df, "ts", W.session(gap), ["k"], aggs())
        native = W._one_step(df, "ts", W.session(gap), ["k"], aggs())
        assert ours.count() > 0
        assert ours.exceptAll(native).isEmpty() and native.exceptAll(ours).isEmpty()


def test_rows_get_their_session(spark):
    df = random_rows(spark)
    marked = W.with_session(df, "ts", W.session("2 MINUTES"), ["k"])
    assert marked.count() == 3000
    counted = marked.groupBy("k", "window_start").agg(F.count(F.lit(1)).alias("n"))
    native = W._one_step(df, "ts", W.session("2 MINUTES"), ["k"], [A.count_rows("n")])
    assert counted.exceptAll(native.select("k", "window_start", "n")).isEmpty()
    assert counted.count() == native.count()


@pytest.mark.parametrize("size, advance", [("10 MINUTES", "1 MINUTE"), ("1 HOUR", "7 MINUTES")])
def test_panes_equal_direct_windows(spark, size, advance):
    df = random_rows(spark)
    panes = W._from_panes(df, "ts", W.hopping(size, advance), ["k"], aggs())
    direct = W._one_step(df, "ts", W.hopping(size, advance), ["k"], aggs())
    assert panes.exceptAll(direct).isEmpty() and direct.exceptAll(panes).isEmpty()


def test_retention_counts_back_from_the_newest_event(spark):
    df = rows(spark, [("a", 0.0), ("a", 3600.0), ("a", 7200.0)])
    window = W.tumbling("1 MINUTE", retention="1 HOUR")
    kept = W.window_agg(df, "ts", window, ["k"], [A.count_rows("n")])
    assert spans(kept) == sorted([(3600.0, 3660.0), (7200.0, 7260.0)], key=str)


def test_distinct_per_window(spark):
    df = spark.createDataFrame(
        [("a", at(0), "x"), ("a", at(1), "x"), ("a", at(2), None), ("a", at(70), "x")],
        "k string, ts timestamp_ntz, u string")
    seen = W.distinct_per_window(df, "ts", W.tumbling("1 MINUTE"), ["k"], "u")
    assert spans(seen, "u") == [(0.0, 60.0, "x"), (60.0, 120.0, "x")]
