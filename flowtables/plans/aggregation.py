"""Grouped aggregate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtables.functions import expressions as E
from flowtables.operators import aggregates as A
from flowtables.operators import lists
from flowtables.plans.projection import events
from flowtables.plans.registry import query
from flowtables.session import written
from flowtables.sources.tables import read_table


def purchase_value():
    return F.when(F.col("event_type") == "purchase", F.col("value"))


@query("""
SELECT user_id % 10 AS journey_code, json_extract_string(props, '$.k') AS k, count(*) AS n
FROM events GROUP BY 1, 2""")
def group_by_expr(spark, folder):
    return (events(spark, folder)
            .groupBy((F.col("user_id") % 10).alias("journey_code"),
                     F.get_json_object("props", "$.k").alias("k"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("""
SELECT user_id, count(*) AS n, round(sum(value), 2) AS total
FROM events GROUP BY user_id HAVING count(*) > 60 AND sum(value) > 1000""")
def having_count(spark, folder):
    grouped = events(spark, folder).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return (grouped.where((F.col("n") > 60) & (F.col("total") > 1000))
            .withColumn("total", F.round("total", 2)))


@query("""
SELECT event_type, count(*) AS n,
       count(CASE WHEN user_id > 20 THEN value END) AS n_value, max(value) AS max_value,
       min(value) AS min_value, round(sum(value), 2) AS sum_value
FROM events GROUP BY event_type""")
def agg_basic(spark, folder):
    return events(spark, folder).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("user_id") > 20, F.col("value"))).alias("n_value"),
        F.max("value").alias("max_value"), F.min("value").alias("min_value"),
        F.round(F.sum("value"), 2).alias("sum_value"))


@query("""
SELECT user_id, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchases,
       CAST(round(CAST(count(CASE WHEN event_type = 'purchase' THEN 1 END) AS DECIMAL(18, 6))
                  / count(*), 4) AS DOUBLE) AS purchase_ratio,
       round(sum(value), 2) / count(*) AS average,
       count(CASE WHEN event_type = 'view' THEN 1 END)
         // nullif(count(CASE WHEN event_type = 'error' THEN 1 END), 0) AS views_per_error
FROM events GROUP BY user_id""")
def conditional_count_ratio(spark, folder):
    kind = F.col("event_type")
    counted = events(spark, folder).groupBy("user_id").agg(
        F.count_if(kind == "purchase").alias("purchases"), F.count(F.lit(1)).alias("n"),
        F.sum("value").alias("total"), F.count_if(kind == "view").alias("views"),
        F.count_if(kind == "error").alias("errors"))
    return counted.select(
        "user_id", "purchases", E.share(F.col("purchases"), F.col("n"), 4).alias("purchase_ratio"),
        (F.round("total", 2) / F.col("n")).alias("average"),
        E.whole_ratio(F.col("views"), F.col("errors")).alias("views_per_error"))


@query("""
SELECT event_type, count(DISTINCT user_id) AS users,
       count(DISTINCT CASE WHEN value > 30 THEN props END) AS props
FROM events GROUP BY event_type""")
def count_distinct(spark, folder):
    return events(spark, folder).groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"),
        F.count_distinct(F.when(F.col("value") > 30, F.col("props"))).alias("props"))


@query("""
SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id DESC) AS newest
FROM (SELECT user_id, event_id,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
WHERE r <= 3 GROUP BY user_id""")
def topk(spark, folder):
    best = A.topk(events(spark, folder), ["user_id"], F.col("event_id"), 3, "newest")
    return best.select("user_id", F.array_join("newest", ",").alias("newest"))


@query("""
SELECT event_type, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k DESC) AS largest
FROM (SELECT event_type, k, row_number() OVER (PARTITION BY event_type ORDER BY k DESC) AS r
      FROM (SELECT DISTINCT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
            FROM events))
WHERE r <= 5 GROUP BY event_type""")
def topk_distinct(spark, folder):
    k = F.get_json_object("props", "$.k").cast("bigint")
    best = A.topk_distinct(events(spark, folder), ["event_type"], k, 5, "largest")
    return best.select("event_type", F.array_join("largest", ",").alias("largest"))


@query("""
SELECT user_id,
       arg_max(value, event_id) FILTER (WHERE event_type = 'purchase') AS last_purchase,
       arg_max(props, event_id) AS last_props
FROM events GROUP BY user_id""")
def latest_by_offset(spark, folder):
    order = F.col("event_id")
    return events(spark, folder).groupBy("user_id").agg(
        A.latest("last_purchase", purchase_value(), order).over_rows(),
        A.latest("last_props", F.col("props"), order).over_rows())


@query("""
SELECT user_id,
       arg_min(value, event_id) FILTER (WHERE event_type = 'purchase') AS first_purchase,
       arg_min(props, event_id) AS first_props
FROM events GROUP BY user_id""")
def earliest_by_offset(spark, folder):
    order = F.col("event_id")
    return events(spark, folder).groupBy("user_id").agg(
        A.earliest("first_purchase", purchase_value(), order).over_rows(),
        A.earliest("first_props", F.col("props"), order).over_rows())


LIST_PARTS = """
SELECT user_id, part, CAST(count(*) AS INTEGER) AS n,
       string_agg(coalesce(CASE WHEN event_type <> 'error' THEN event_type END, 'null'), ','
                  ORDER BY event_id) AS actions,
       string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids
FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // {size} AS part
      FROM events)
GROUP BY user_id, part"""


def action_lists(spark, folder, part_size):
    parts = lists.list_parts(
        events(spark, folder), ["user_id"], F.col("event_id"),
        {"actions": F.when(F.col("event_type") != "error", F.col("event_type")),
         "ids": F.col("event_id")}, part_size)
    return parts.select(
        "user_id", "part", F.size("actions").alias("n"),
        F.array_join("actions", ",", "null").alias("actions"),
        F.array_join("ids", ",").alias("ids"))


@query(LIST_PARTS.format(size=lists.PART_SIZE))
def collect_list_ordered(spark, folder):
    return action_lists(spark, folder, lists.PART_SIZE)


@query(LIST_PARTS.format(size=64))
def collect_list_parts(spark, folder):
    """The same lists in small parts: users with more than 64 events are split."""
    return action_lists(spark, folder, 64)


@query("""
SELECT user_id, 0::BIGINT AS part, string_agg(event_type || '=' || props, ';' ORDER BY event_type)
         AS last_props
FROM (SELECT user_id, event_type, arg_max(props, event_id) AS props FROM events GROUP BY 1, 2)
GROUP BY user_id""")
def agg_as_map(spark, folder):
    maps = lists.map_parts(events(spark, folder), ["user_id"], F.col("event_type"),
                           F.col("props"), F.col("event_id"), "last_props")
    return maps.select("user_id", "part", E.map_text(F.col("last_props")).alias("last_props"))


@query("""
SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""")
def first_occurrence(spark, folder):
    rows = events(spark, folder).select("user_id", "event_type", "event_id", "value")
    return A.first_occurrence(rows, ["user_id", "event_type"], "event_id")


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity,
       round(sum(l_extendedprice), 2) AS price, max(l_discount) AS max_discount,
       count(DISTINCT l_suppkey) AS suppliers
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def table_ctas(spark, folder):
    """A derived table: aggregate of the lines, written and read back."""
    lines = read_table(spark, folder, "lineitem")
    return written(lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"),
        F.max("l_discount").alias("max_discount"),
        F.count_distinct("l_suppkey").alias("suppliers")), "lines-by-flag")
