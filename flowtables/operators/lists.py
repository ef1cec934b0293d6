"""Lists and maps per group, in bounded parts, and lookups that need no list.

A list or map aggregate puts a group into one row. To keep that row bounded for a
group that holds a large share of the data, a long list continues in further
rows: ``part`` 0, 1, 2, ... Nothing is dropped, and what a list says does not depend
on ``part_size``. Groups of up to ``part_size`` rows, the usual case, give exactly one
row with ``part`` 0. Questions about a whole list, such as what follows an item, are
answered from positions (:func:`transitions`), not from the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtables.session import written

PART_SIZE = 10_000


def _long_groups(counted: DataFrame, part_size: int) -> DataFrame | None:
    """Groups above ``part_size`` rows: at most rows / part_size of them."""
    long = written(counted.where(F.col("_rows") > part_size).select("_group"), "long-groups")
    return None if long.isEmpty() else long


def _grouped(df: DataFrame, keys: list[str], *columns: Column) -> DataFrame:
    # One struct as the key joins null keys to null keys with a plain equality.
    return df.select(F.struct(*keys).alias("_group"), *columns)


def _ordered(order: Column) -> Column:
    """The order in its own type, nulls last."""
    return F.struct(order.isNull().alias("missing"), order.alias("value"))


def list_parts(df: DataFrame, keys: list[str], order: Column, items: dict[str, Column],
               part_size: int = PART_SIZE, sizes: DataFrame | None = None,
               costly: bool = False) -> DataFrame:
    """Ordered lists per group: ``keys``, ``part`` and one array per entry of ``items``.

    ``order`` is a per-row unique order of any orderable type: an arrival offset, a
    timestamp, a struct of partition and offset. Rows without an order come last, in
    the order of their items. All arrays of a row have the same length; null items stay. Part
    ``n`` holds the items ``n * part_size + 1`` to ``(n + 1) * part_size`` of the group.

    Finding the long groups takes a pass over the key columns. A caller that knows
    the group sizes passes them as ``sizes``: ``keys`` and ``rows``. Where there are
    long groups the rows are read several times; ``costly`` rows are written out first.
    """
    rows = _grouped(df, keys, _ordered(order).alias("_order"),
                    F.struct(*[c.alias(n) for n, c in items.items()]).alias("_item"))
    counted = (rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows")) if sizes is None
               else _grouped(sizes, keys, F.col("rows").alias("_rows")))
    long = _long_groups(counted, part_size)
    if long is None:
        placed = rows.withColumn("part", F.lit(0).cast("bigint"))
    else:
        rows = written(rows, "list-rows") if costly else rows
        short = rows.join(long, "_group", "left_anti").withColumn("part", F.lit(0).cast("bigint"))
        far = _positioned(rows.join(long, "_group", "left_semi"))
        far = far.withColumn("part", F.floor(F.col("_position") / part_size)).drop("_position")
        placed = short.unionByName(far)
    ordered = F.sort_array(F.collect_list(F.struct("_order", "_item")))
    gathered = placed.groupBy("_group", "part").agg(ordered.alias("_list"))
    return gathered.select("_group.*", "part", *[
        F.col("_list._item")[name].alias(name) for name in items])


def _positioned(rows: DataFrame) -> DataFrame:
    """Number the rows of each group from 0 without bringing a group into one task.

    Rows are dealt by ranges of (group, order), so a long group spreads over many
    partitions. A row's position is the number of the group's rows in the partitions
    before, at most one count per partition, plus its rank within its own.
    """
    dealt = written(rows.repartitionByRange("_group", "_order", "_item")
                    .withColumn("_range", F.spark_partition_id()), "list-ranges")
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = (dealt.groupBy("_group", "_range").agg(F.count(F.lit(1)).alias("_rows"))
              .select("_group", "_range",
                      F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")))
    rank = F.row_number().over(Window.partitionBy("_group", "_range").orderBy("_order", "_item"))
    ranked = dealt.withColumn("_rank", rank)
    return (ranked.join(starts, ["_group", "_range"])
            .withColumn("_position", F.col("_start") + F.col("_rank") - 1)
            .select("_group", "_order", "_item", "_position"))


def transitions(df: DataFrame, keys: list[str], order: Column, item: Column) -> DataFrame:
    """``keys``, ``item`` and ``next_item``: what follows the last occurrence of each item.

    One row per group and distinct item that is not null; null where the item ends its
    list. The whole ordered list counts, whatever its length: positions are joined, so no
    row or task holds a list.
    """
    rows = _grouped(df, keys, _ordered(order).alias("_order"), F.struct(item.alias("item")).alias("_item"))
    placed = written(_positioned(rows).select(
        "_group", F.col("_item.item").alias("item"), "_position"), "positions")
    last = (placed.where(F.col("item").isNotNull()).groupBy("_group", "item")
            .agg((F.max("_position") + 1).alias("_position")))
    following = placed.select("_group", "_position", F.col("item").alias("next_item"))
    return (last.join(following, ["_group", "_position"], "left")
            .select("_group.*", "item", "next_item"))


def map_entries(df: DataFrame, keys: list[str], map_key: Column, map_value: Column,
                order: Column) -> DataFrame:
    """The map aggregate as a table: one row per group and map key, last value wins.

    Look a map key up by a join with this table, whatever the size of the map. No group column
    may be called ``map_key`` or ``map_value``.
    """
    if {"map_key", "map_value"} & set(keys):
        raise ValueError("a group column must not be called map_key or map_value")
    rows = df.select(*keys, map_key.alias("map_key"), map_value.alias("map_value"),
                     _ordered_first(order).alias("_order")).where(F.col("map_key").isNotNull())
    return (rows.groupBy(*keys, "map_key")
            .agg(F.max_by("map_value", "_order").alias("map_value")))


def _ordered_first(order: Column) -> Column:
    """Rows without an order lose against those with one."""
    return F.struct(order.isNotNull().alias("known"), order.alias("value"))


def map_parts(df: DataFrame, keys: list[str], map_key: Column, map_value: Column,
              order: Column, name: str, parts: int = 1) -> DataFrame:
    """One map per group and part: ``keys``, ``part`` and the map ``name``.

    The caller chooses the number of ``parts``; a map key is in the part that the hash of the
    key names, in every group. With one part a row holds a group's whole map.
    """
    entries = _grouped(map_entries(df, keys, map_key, map_value, order), keys,
                       F.struct("map_key", "map_value").alias("_entry"))
    part = F.pmod(F.xxhash64("_entry.map_key"), F.lit(parts)).cast("bigint")
    return (entries.withColumn("part", part).groupBy("_group", "part")
            .agg(F.map_from_entries(F.collect_list("_entry")).alias(name))
            .select("_group.*", "part", name))
