"""Aggregates that can be taken in two steps, and top-k per group.

An :class:`Agg` knows its one-step form over rows and its two-step form: columns
computed per small slice of a group, then merged. Windows use the second form to
shrink a hot key before any step that needs the key in one place. Slices can also be
merged into slices, for tables that are kept over many batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Agg:
    name: str
    whole: Column
    slices: dict[str, Column]
    merge: Callable[[Callable[[str], Column]], Column]
    again: dict[str, Callable[[Callable[[str], Column]], Column]]

    def over_rows(self) -> Column:
        return self.whole.alias(self.name)

    def per_slice(self) -> list[Column]:
        return [column.alias(f"_{self.name}_{part}") for part, column in self.slices.items()]

    def over_slices(self) -> Column:
        return self.merge(self._part).alias(self.name)

    def slices_of_slices(self) -> list[Column]:
        """Slices merged into slices, which can be merged further."""
        return [merge(self._part).alias(f"_{self.name}_{part}") for part, merge in self.again.items()]

    def _part(self, part: str) -> Column:
        return F.col(f"_{self.name}_{part}")


def _same(name: str, whole: Column, merge) -> Agg:
    def merged(part):
        return merge(part("v"))

    return Agg(name, whole, {"v": whole}, merged, {"v": merged})


def count_rows(name: str) -> Agg:
    return _same(name, F.count(F.lit(1)), F.sum)


def count_values(name: str, value: Column) -> Agg:
    return _same(name, F.count(value), F.sum)


def count_when(name: str, condition: Column) -> Agg:
    return _same(name, F.count_if(condition), F.sum)


def total(name: str, value: Column) -> Agg:
    return _same(name, F.sum(value), F.sum)


def smallest(name: str, value: Column) -> Agg:
    return _same(name, F.min(value), F.min)


def largest(name: str, value: Column) -> Agg:
    return _same(name, F.max(value), F.max)


def latest(name: str, value: Column, order: Column) -> Agg:
    """Last non-null value by arrival order."""
    seen = F.when(value.isNotNull(), order)
    return Agg(name, F.max_by(value, seen), {"v": F.max_by(value, seen), "at": F.max(seen)},
               lambda part: F.max_by(part("v"), part("at")),
               {"v": lambda part: F.max_by(part("v"), part("at")), "at": lambda part: F.max(part("at"))})


def earliest(name: str, value: Column, order: Column) -> Agg:
    """First non-null value by arrival order."""
    seen = F.when(value.isNotNull(), order)
    return Agg(name, F.min_by(value, seen), {"v": F.min_by(value, seen), "at": F.min(seen)},
               lambda part: F.min_by(part("v"), part("at")),
               {"v": lambda part: F.min_by(part("v"), part("at")), "at": lambda part: F.min(part("at"))})


# Spark limits each group ahead of the shuffle only up to this many rows
# (spark.sql.optimizer.windowGroupLimitThreshold).
RANK_LIMIT_SETTING = "spark.sql.optimizer.windowGroupLimitThreshold"
# Partitions whose best rows meet in a task of each round, if it takes rounds.
LEVELS = (1, 64, 4096)


def topk(df: DataFrame, keys: list[str], value: Column, k: int, name: str) -> DataFrame:
    """The ``k`` largest values per group in descending order, duplicates kept.

    Each task keeps its own ``k`` best rows per group before the shuffle. Beyond
    the size up to which Spark does so by itself, rounds over more and more
    partitions do it: no task of a round reads more than one partition's rows of a
    group, then 64 times ``k`` rows.
    """
    rows = df.select(*keys, value.alias("_value"))
    if k > int(df.sparkSession.conf.get(RANK_LIMIT_SETTING, "1000")):
        rows = rows.withColumn("_part", F.spark_partition_id())
        for width in LEVELS:
            salted = rows.withColumn("_salt", F.floor(F.col("_part") / width))
            rows = _best(salted, [*keys, "_salt"], k).drop("_salt")
        rows = rows.drop("_part")
    return (_best(rows, keys, k).groupBy(*keys)
            .agg(F.sort_array(F.collect_list("_value"), asc=False).alias(name)))


def topk_distinct(df: DataFrame, keys: list[str], value: Column, k: int, name: str) -> DataFrame:
    """The ``k`` largest different values per group in descending order."""
    distinct = df.select(*keys, value.alias("_value")).distinct()
    return topk(distinct, keys, F.col("_value"), k, name)


def _best(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    by_value = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("_value"))
    return (rows.withColumn("_rank", F.row_number().over(by_value))
                .where(F.col("_rank") <= k).drop("_rank"))


def first_occurrence(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of every key by ``order``; each task keeps one row per key."""
    by_order = Window.partitionBy(*keys).orderBy(order)
    return (df.withColumn("_rank", F.row_number().over(by_order))
              .where(F.col("_rank") == 1).drop("_rank"))
