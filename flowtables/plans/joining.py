"""Left join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtables.operators import joins
from flowtables.operators.tables import latest_per_key, write_partitions
from flowtables.plans.registry import query
from flowtables.session import new_folder
from flowtables.sources.tables import read_table


@query("""
SELECT c_custkey, c_name, o_orderkey, o_totalprice
FROM customer LEFT JOIN (
  SELECT * FROM (SELECT * FROM orders
                 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
  WHERE o_orderstatus <> 'F') ON o_custkey = c_custkey
WHERE c_acctbal >= 0""")
def left_join_table(spark, folder):
    """Each customer with the newest version of their order, where that one is not finished."""
    customers = read_table(spark, folder, "customer").where(F.col("c_acctbal") >= 0).alias("c")
    versions = read_table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    # The table side holds one row per key; a filter before that would bring old versions back.
    newest = latest_per_key(versions, ["o_custkey"], F.col("o_orderkey"))
    newest = newest.where("o_orderstatus <> 'F'").alias("o")
    return (customers.join(newest, F.col("c.c_custkey") == F.col("o.o_custkey"), "left")
            .select("c.c_custkey", "c.c_name", "o.o_orderkey", "o.o_totalprice"))


@query("""
SELECT o_orderkey, c_name, n_name, r_name
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""")
def left_join_chain(spark, folder):
    customer, nation, region = (read_table(spark, folder, name)
                                for name in ("customer", "nation", "region"))
    return (read_table(spark, folder, "orders")
            .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select("o_orderkey", "c_name", "n_name", "r_name"))


@query("""
SELECT o_orderkey, c_custkey, c_acctbal
FROM orders LEFT JOIN customer
  ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20 AND c_mktsegment != 'BUILDING'""")
def left_join_theta(spark, folder):
    orders, customer = (read_table(spark, folder, name) for name in ("orders", "customer"))
    condition = ((F.col("o_custkey") == F.col("c_custkey"))
                 & (F.col("o_totalprice") > F.col("c_acctbal") * 20)
                 & (F.col("c_mktsegment") != "BUILDING"))
    return orders.join(customer, condition, "left").select("o_orderkey", "c_custkey", "c_acctbal")


@query("""
SELECT event_id, value, n_name
FROM events LEFT JOIN nation ON value >= n_nationkey * 4.0 AND value < n_nationkey * 4.0 + 6.0""")
def left_join_range(spark, folder):
    """A condition without any equality, over ranges that overlap."""
    events = read_table(spark, folder, "events").select("event_id", "value")
    low = F.col("n_nationkey") * F.lit(4.0)
    ranges = read_table(spark, folder, "nation").select(
        "n_name", low.alias("low"), (low + 6.0).alias("high"))
    return (joins.left_join_range(events, ranges, "value", "low", "high", band=8.0)
            .select("event_id", "value", "n_name"))


@query("""
SELECT event_id, c_custkey, c_nationkey
FROM events LEFT JOIN customer ON user_id = c_custkey OR event_id = c_custkey * 7""")
def left_join_or(spark, folder):
    events = read_table(spark, folder, "events")
    customer = read_table(spark, folder, "customer")
    conditions = [events["user_id"] == customer["c_custkey"],
                  events["event_id"] == customer["c_custkey"] * 7]
    return (joins.left_join_any(events, customer, conditions)
            .select("event_id", "c_custkey", "c_nationkey"))


@query("""
SELECT c_nationkey, count(*) AS n, round(sum(o_totalprice), 2) AS total,
       1::BIGINT AS partitions
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
WHERE o_totalprice > 1000 AND c_mktsegment IS NOT NULL GROUP BY c_nationkey""")
def join_where_partition(spark, folder):
    orders, customer = (read_table(spark, folder, name) for name in ("orders", "customer"))
    joined = (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
              .where((F.col("o_totalprice") > 1000) & F.col("c_mktsegment").isNotNull()))
    sink = new_folder(spark, "by-nation")
    write_partitions(joined.select("c_nationkey", "o_totalprice"), "c_nationkey", 8, sink)
    return spark.read.parquet(sink).groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.count_distinct("partition").alias("partitions"))


@query("""
WITH sales AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
prices AS (SELECT user_id, ts AS since, arg_max(props, event_id) AS config
           FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
SELECT event_id, s.user_id, value, since, config
FROM sales s ASOF LEFT JOIN prices p ON s.user_id = p.user_id AND p.since <= s.ts""")
def left_join_as_of(spark, folder):
    """Purchases with the table row that was valid when they happened."""
    rows = read_table(spark, folder, "events")
    sales = rows.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    prices = rows.where("event_type = 'click'").select(
        "user_id", F.col("ts").alias("since"), F.col("props").alias("config"), F.col("event_id").alias("seen"))
    joined = joins.left_join_as_of(sales, prices, ["user_id"], "ts", "since", order=F.col("seen"))
    return joined.select("event_id", "user_id", "value", "since", "config")
