"""Event-time window queries on batch tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtables.operators import aggregates as A
from flowtables.operators import windows as W
from flowtables.plans.projection import events
from flowtables.plans.registry import query

COUNTED = """count(*) AS n, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchases,
       round(sum(value), 2) AS total, max(value) AS max_value"""


def counted() -> list[A.Agg]:
    value = F.col("value")
    return [A.count_rows("n"), A.count_when("purchases", F.col("event_type") == "purchase"),
            A.total("total", value), A.largest("max_value", value)]


def rounded(df):
    return df.withColumn("total", F.round("total", 2))


@query(f"""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
       time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, {COUNTED}
FROM events GROUP BY ALL""")
def window_tumbling(spark, folder):
    return rounded(W.window_agg(events(spark, folder), "ts", W.tumbling("1 HOUR"),
                                ["event_type"], counted()))


HOPPING = """
SELECT s AS window_start, s + INTERVAL {size} MINUTES AS window_end, {key}, {columns}
FROM (SELECT *, time_bucket(INTERVAL {advance} MINUTES, ts) - k * INTERVAL {advance} MINUTES AS s
      FROM {source}, range(0, {ratio}) r(k))
WHERE ts < s + INTERVAL {size} MINUTES GROUP BY ALL"""


@query(HOPPING.format(size=20, advance=10, ratio=2, key="event_type", columns=COUNTED,
                      source="events"))
def window_hopping(spark, folder):
    return rounded(W.window_agg(events(spark, folder), "ts",
                                W.hopping("20 MINUTES", "10 MINUTES"),
                                ["event_type"], counted()))


@query(HOPPING.format(size=60, advance=5, ratio=12, key="event_type", columns=COUNTED + """,
       arg_max(props, event_id) AS last_props""", source="events"))
def window_hopping_panes(spark, folder):
    """Twelve windows per row: rows are aggregated into five-minute panes first."""
    aggs = [*counted(), A.latest("last_props", F.col("props"), F.col("event_id"))]
    return rounded(W.window_agg(events(spark, folder), "ts", W.hopping("1 HOUR", "5 MINUTES"),
                                ["event_type"], aggs))


SESSIONS = """
WITH marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL {gap}
                 THEN 0 ELSE 1 END AS opens FROM {source}),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS number FROM marked)
"""


@query(SESSIONS.format(gap="12 HOURS", source="events") + f"""
SELECT min(ts) AS window_start, max(ts) + INTERVAL 12 HOURS AS window_end, user_id, {COUNTED},
       arg_min(props, event_id) AS first_props
FROM numbered GROUP BY user_id, number""")
def window_session(spark, folder):
    aggs = [*counted(), A.earliest("first_props", F.col("props"), F.col("event_id"))]
    return rounded(W.window_agg(events(spark, folder), "ts", W.session("12 HOURS"),
                                ["user_id"], aggs))


@query(SESSIONS.format(gap="6 HOURS", source="(SELECT * FROM events WHERE event_type != 'error')")
       + f"""
SELECT min(ts) AS window_start, max(ts) + INTERVAL 6 HOURS AS window_end, user_id, {COUNTED}
FROM numbered GROUP BY user_id, number HAVING count(*) >= 2""")
def window_session_where(spark, folder):
    rows = events(spark, folder).where(F.col("event_type") != "error")
    sessions = W.window_agg(rows, "ts", W.session("6 HOURS"), ["user_id"], counted())
    return rounded(sessions.where(F.col("n") >= 2))


@query(f"""
SELECT * FROM (
  SELECT time_bucket(INTERVAL 30 MINUTES, ts) AS window_start,
         time_bucket(INTERVAL 30 MINUTES, ts) + INTERVAL 30 MINUTES AS window_end,
         user_id % 10 AS journey_code, {COUNTED}
  FROM events GROUP BY ALL)
WHERE window_end > (SELECT max(ts) FROM events) - INTERVAL 48 HOURS""")
def window_retention(spark, folder):
    rows = events(spark, folder).withColumn("journey_code", F.col("user_id") % 10)
    window = W.tumbling("30 MINUTES", retention="48 HOURS")
    return rounded(W.window_agg(rows, "ts", window, ["journey_code"], counted()))


@query("""
SELECT time_bucket(INTERVAL 15 SECONDS, t) AS window_start,
       time_bucket(INTERVAL 15 SECONDS, t) + INTERVAL 15 SECONDS AS window_end, count(*) AS n
FROM (SELECT make_timestamp((epoch_us(ts) // 1000) * 1000) AS t FROM events) GROUP BY ALL""")
def event_time_column(spark, folder):
    """Event time taken from a BIGINT column of epoch milliseconds."""
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = (events(spark, folder).select(millis.alias("timestamp"))
            .withColumn("ts", F.timestamp_millis("timestamp").cast("timestamp_ntz")))
    return W.window_agg(rows, "ts", W.tumbling("15 SECONDS"), [], [A.count_rows("n")])


@query(HOPPING.format(size=20, advance=10, ratio=2, key="event_type",
                      columns="count(DISTINCT user_id) AS users", source="events"))
def window_count_distinct(spark, folder):
    window = W.hopping("20 MINUTES", "10 MINUTES")
    rows = W.distinct_per_window(events(spark, folder), "ts", window, ["event_type"], "user_id")
    return rows.groupBy(*W.BOUNDS, "event_type").agg(F.count("user_id").alias("users"))


