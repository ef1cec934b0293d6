"""Keyed table, fingerprint, diff and dependency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtables.operators import tables
from flowtables.plans.registry import query
from flowtables.session import new_folder
from flowtables.sources.tables import read_table
from flowtables.streaming.versions import read_version, replace_version


@query("""
SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""")
def table_latest_per_key(spark, folder):
    orders = read_table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return tables.latest_per_key(orders, ["o_custkey"], F.col("o_orderkey"))


@query("""
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority""")
def ctas_replace(spark, folder):
    """A derived table, then its replacement under the same name."""
    orders = read_table(spark, folder, "orders")
    path = new_folder(spark, "orders-by-priority")
    for status in ("O", "F"):
        derived = orders.where(F.col("o_orderstatus") == status).groupBy("o_orderpriority").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
        replace_version(derived, path)
    return read_version(spark, path, derived.schema)


@query("""
SELECT c_custkey, translate(base64(unhex(sha256(
         length(c_name) || ':' || c_name
         || length(c_nationkey::VARCHAR) || ':' || c_nationkey::VARCHAR
         || coalesce(length(segment) || ':' || segment, '-')))), '+/', '-_') AS fingerprint
FROM (SELECT *, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer)""")
def row_fingerprint(spark, folder):
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return read_table(spark, folder, "customer").select(
        "c_custkey",
        tables.fingerprint(F.col("c_name"), F.col("c_nationkey"), segment).alias("fingerprint"))


DESIRED = "o_orderpriority <> '1-URGENT'"
OBSERVED = "o_orderpriority <> '5-LOW'"


@query(f"""
WITH desired AS (SELECT o_orderkey, o_orderstatus AS status, o_orderpriority
                 FROM orders WHERE {DESIRED}),
observed AS (SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN NULL
                                     ELSE o_orderstatus END AS status, o_orderpriority
             FROM orders WHERE {OBSERVED})
SELECT coalesce(d.o_orderkey, o.o_orderkey) AS o_orderkey,
       CASE WHEN o.o_orderkey IS NULL THEN 'create' WHEN d.o_orderkey IS NULL THEN 'drop'
            WHEN d.status IS NOT DISTINCT FROM o.status
             AND d.o_orderpriority = o.o_orderpriority THEN 'keep' ELSE 'replace' END AS action
FROM desired d FULL JOIN observed o ON d.o_orderkey = o.o_orderkey""")
def snapshot_diff(spark, folder):
    orders = read_table(spark, folder, "orders")
    status = F.col("o_orderstatus")
    desired = orders.where(DESIRED).select("o_orderkey", status.alias("status"), "o_orderpriority")
    observed = orders.where(OBSERVED).select(
        "o_orderkey", F.when(F.col("o_totalprice") >= 50000, status).alias("status"),
        "o_orderpriority")
    return tables.snapshot_diff(desired, observed, ["o_orderkey"])


@query("""
WITH desired AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 997 <> 5),
observed AS (SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 7 THEN 'X' ELSE o_orderstatus END
                    AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 997 <> 11)
SELECT coalesce(d.o_orderkey, o.o_orderkey) AS o_orderkey,
       CASE WHEN o.o_orderkey IS NULL THEN 'create' WHEN d.o_orderkey IS NULL THEN 'drop'
            WHEN d.o_orderstatus = o.o_orderstatus THEN 'keep' ELSE 'replace' END AS action
FROM desired d FULL JOIN observed o ON d.o_orderkey = o.o_orderkey""")
def snapshot_diff_sparse(spark, folder):
    """Few changes: only the ranges of keys whose digests differ are compared."""
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    desired = orders.where("o_orderkey % 997 <> 5")
    status = F.when(F.col("o_orderkey") % 1000 == 7, "X").otherwise(F.col("o_orderstatus"))
    observed = orders.where("o_orderkey % 997 <> 11").withColumn("o_orderstatus", status)
    return tables.snapshot_diff_sparse(desired, observed, "o_orderkey")


@query("""
WITH RECURSIVE nodes AS (SELECT DISTINCT conv_id, turn FROM conversations),
reached AS (
  SELECT conv_id, turn, 0 AS level FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM nodes p WHERE p.conv_id = n.conv_id AND p.turn = n.turn - 1)
  UNION ALL
  SELECT n.conv_id, n.turn, level + 1
  FROM reached r JOIN nodes n ON n.conv_id = r.conv_id AND n.turn = r.turn + 1)
SELECT conv_id, turn, CAST(max(level) AS INTEGER) AS level FROM reached GROUP BY conv_id, turn""")
def dependency_levels(spark, folder):
    """Every conversation turn needs the turn before it."""
    turns = read_table(spark, folder, "conversations").select(
        F.struct("conv_id", "turn").alias("node"))
    before = F.struct(F.col("node.conv_id").alias("conv_id"),
                      (F.col("node.turn") - 1).alias("turn"))
    levels = tables.dependency_levels(turns, turns.select("node", before.alias("needs")))
    return levels.select("node.conv_id", "node.turn", "level")
