"""Left joins of a stream (or table) with a table.

Plain and chained equality joins are ``DataFrame.join(..., "left")``: the planner
broadcasts a side whose measured size allows it and AQE splits hot keys. Here are
the conditions that Spark would run as a nested loop over a broadcast side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left_join_any(left: DataFrame, right: DataFrame, conditions: list[Column]) -> DataFrame:
    """Left join on ``c1 OR c2 OR ...``, each of them holding an equality.

    One hash join per condition. A pair belongs to the first condition it meets,
    and left rows that meet none are added once.
    """
    joined = []
    for at, condition in enumerate(conditions):
        earlier = [~F.coalesce(c, F.lit(False)) for c in conditions[:at]]
        joined.append(left.join(right, reduce(lambda a, b: a & b, earlier, condition)))
    lonely = reduce(lambda rows, c: rows.join(right, c, "left_anti"), conditions, left)
    padding = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema]
    return reduce(DataFrame.union, joined).union(lonely.select(*left.columns, *padding))


def left_join_range(left: DataFrame, right: DataFrame, value: str, low: str, high: str,
                    band: float, on: list[str] | None = None) -> DataFrame:
    """Left join on ``low <= value AND value < high`` (and equal ``on`` columns).

    Each range is listed under the bands of width ``band`` it touches; a left row
    has one band, so an equality join on the band finds every pair exactly once. A
    range takes ``(high - low) / band`` rows: choose a band about as wide as the usual range.
    """
    on = on or []
    ranges = (right.where(F.col(low) < F.col(high))
              .withColumnsRenamed({name: f"_{name}" for name in on})
              .withColumn("_band", F.explode(F.sequence(
                  F.floor(F.col(low) / band), F.floor(F.col(high) / band)))))
    condition = reduce(lambda a, b: a & b, [
        *[left[name] == ranges[f"_{name}"] for name in on],
        F.floor(left[value] / band) == ranges["_band"],
        left[value] >= ranges[low], left[value] < ranges[high]])
    kept = [name for name in right.columns if name not in on]
    return left.join(ranges, condition, "left").select(
        *[left[name] for name in left.columns], *[ranges[name] for name in kept])


def left_join_as_of(rows: DataFrame, versions: DataFrame, on: list[str], at: str, since: str,
                    order: Column | None = None, band: float = 86_400.0) -> DataFrame:
    """Left join with the version of the table that was valid at each row's time.

    The version of a key is valid from its ``since`` (inclusive) until the next one; of versions
    of one time the greatest by ``order`` counts, or any one without an order. Rows before the
    first version, and rows with a null key or time, get nulls. ``versions`` brings ``on``,
    ``since`` and columns that ``rows`` has not. Both times are of one timestamp type.

    Time is cut into bands of ``band`` seconds. Rows meet the versions of their own band, so a
    hot key is spread over its bands; what is valid at the start of a band comes from one row per
    key and band that occur. A key's bands meet in one task, its rows and versions do not.
    """
    def banded(df, time):
        seconds = F.unix_micros(F.col(time).cast("timestamp"))
        return df.select(F.struct(*on).alias("_group"), F.floor(seconds / (band * 1e6)).alias("_band"),
                         F.col(time).alias("_time"), "*")

    values = [name for name in versions.columns if name not in on]
    known = versions.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*on, since)]))
    version = F.struct(*values)
    newest = F.max_by(version, order) if order is not None else F.any_value(version)
    known = (banded(known, since).groupBy("_group", "_band", "_time")
             .agg(newest.alias("_version")))
    left = banded(rows, at).withColumn("_row", F.struct(*rows.columns)).select(
        "_group", "_band", "_time", "_row")

    events = known.withColumn("_row", F.lit(None).cast(left.schema["_row"].dataType)).unionByName(
        left.withColumn("_version", F.lit(None).cast(known.schema["_version"].dataType)))
    # At one time versions come before rows.
    by_time = (Window.partitionBy("_group", "_band").orderBy("_time", F.col("_row").isNotNull())
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = events.withColumn("_within", F.last("_version", ignorenulls=True).over(by_time)).where(
        F.col("_row").isNotNull())

    last = known.groupBy("_group", "_band").agg(F.max_by("_version", "_time").alias("_version"))
    asked = left.select("_group", "_band").distinct().withColumn(
        "_version", F.lit(None).cast(known.schema["_version"].dataType))
    before = Window.partitionBy("_group").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    carried = (last.unionByName(asked).groupBy("_group", "_band")
               .agg(F.any_value("_version", ignoreNulls=True).alias("_version"))
               .withColumn("_carried", F.last("_version", ignorenulls=True).over(before))
               .where(F.col("_carried").isNotNull()).select("_group", "_band", "_carried"))
    joined = within.join(carried, ["_group", "_band"], "left").withColumn(
        "_valid", F.when(F.col("_time").isNotNull(), F.coalesce("_within", "_carried")))
    return joined.select("_row.*", *[F.col("_valid")[name].alias(name) for name in values])
