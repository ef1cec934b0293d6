"""Event-time windows with grace and retention.

The same :class:`Window` and aggregate list serve batch tables and streams.
On streams the grace period is the watermark delay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from flowtables.operators.aggregates import Agg

UNITS = {"SECOND": 1, "MINUTE": 60, "HOUR": 3600}


def duration(text: str) -> timedelta:
    """``20 MINUTES`` and the like: a whole number and SECOND(S), MINUTE(S) or HOUR(S)."""
    match = re.fullmatch(r"\s*(\d+)\s+(SECOND|MINUTE|HOUR)S?\s*", text, re.I)
    if not match:
        raise ValueError(f"{text!r} is not a whole number of seconds, minutes or hours")
    return timedelta(seconds=int(match[1]) * UNITS[match[2].upper()])


def _interval(text: str) -> str:
    return f"{int(duration(text).total_seconds())} seconds"


def interval(text: str) -> Column:
    return F.expr(f"interval {_interval(text)}")


@dataclass(frozen=True)
class Window:
    """``kind`` tumbling, hopping or session; ``size`` is the gap of a session."""

    kind: str
    size: str
    advance: str | None = None
    retention: str | None = None
    grace: str = "0 seconds"

    def __post_init__(self):
        size, advance = duration(self.size), duration(self.advance or self.size)
        if self.kind not in ("tumbling", "hopping", "session"):
            raise ValueError(f"unknown window kind {self.kind!r}")
        if (self.kind == "hopping") != (self.advance is not None):
            raise ValueError("ADVANCE BY belongs to hopping windows, and they need it")
        if not timedelta(0) < advance <= size:
            raise ValueError("the advance must be above zero and at most the size")
        duration(self.grace)
        if self.retention is not None and duration(self.retention) < size:
            raise ValueError("the retention must not be below the window size")

    def kept(self) -> Window:
        """The same window without a retention, for streams."""
        return replace(self, retention=None)

    def over(self, ts: str) -> Column:
        if self.kind == "session":
            return F.session_window(ts, _interval(self.size))
        return F.window(ts, _interval(self.size), _interval(self.advance or self.size))


def tumbling(size: str, **options) -> Window:
    return Window("tumbling", size, **options)


def hopping(size: str, advance: str, **options) -> Window:
    return Window("hopping", size, advance, **options)


def session(gap: str, **options) -> Window:
    return Window("session", gap, **options)


BOUNDS = ("window_start", "window_end")

# Windows of a row from which on panes are aggregated first. Below it, Spark's own
# expansion followed by its map-side aggregate moves less.
PANES_FROM = 6


def window_agg(df: DataFrame, ts: str, window: Window, keys: list[str],
               aggs: list[Agg]) -> DataFrame:
    """Aggregate per window and key: ``window_start``, ``window_end``, keys, aggregates."""
    if df.isStreaming:
        if window.retention:
            raise ValueError("a stream has no newest event: aggregate with window.kept() and "
                             "apply retained() to the table that is read")
        return _one_step(df.withWatermark(ts, _interval(window.grace)), ts, window, keys, aggs)
    newest = df.agg(F.max(ts)).scalar() if window.retention else None
    if window.retention and window.kind != "session":
        # An event ends its last window less than one size later.
        df = df.where(F.col(ts) > newest - interval(window.retention) - interval(window.size))
    if window.kind == "session":
        result = _sessions(df, ts, window, keys, aggs)
    elif window.kind == "hopping" and duration(window.size) >= PANES_FROM * duration(window.advance):
        result = _from_panes(df, ts, window, keys, aggs)
    else:
        result = _one_step(df, ts, window, keys, aggs)
    return retained(result, newest, window.retention) if window.retention else result


def _one_step(df, ts, window, keys, aggs):
    grouped = df.groupBy(window.over(ts).alias("_w"), *keys).agg(*[a.over_rows() for a in aggs])
    return grouped.select(F.col("_w.start").alias("window_start"),
                          F.col("_w.end").alias("window_end"),
                          *keys, *[a.name for a in aggs])


def _pane(window: Window) -> str:
    """Longest span that divides both size and advance: no window cuts through it."""
    size = int(duration(window.size).total_seconds())
    step = int(duration(window.advance).total_seconds())
    while step:
        size, step = step, size % step
    return f"{size} seconds"


def _from_panes(df, ts, window, keys, aggs):
    """Aggregate each row once into its pane, then each pane into its windows."""
    panes = (df.groupBy(F.window(ts, _pane(window)).alias("_pane"), *keys)
             .agg(*[column for a in aggs for column in a.per_slice()])
             .withColumn("_at", F.col("_pane.start")))
    grouped = panes.groupBy(window.over("_at").alias("_w"), *keys).agg(
        *[a.over_slices() for a in aggs])
    return grouped.select(F.col("_w.start").alias("window_start"),
                          F.col("_w.end").alias("window_end"),
                          *keys, *[a.name for a in aggs])


def _tiles(df, ts, window, keys, aggs):
    """Pre-aggregate rows that cannot be in different sessions.

    Rows of a key within one tile of the gap's length are closer than the gap. A
    hot key thereby shrinks to at most one row per tile, however many rows it has,
    in an ordinary map-side combined aggregate.
    """
    return (_tiled(df, ts, window).groupBy(*keys, "_tile")
            .agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"),
                 *[column for a in aggs for column in a.per_slice()]))


def _tiled(df, ts, window):
    return (df.withColumn("_w", F.window(ts, _interval(window.size)))
            .withColumn("_tile", F.col("_w.start")).drop("_w"))


def _with_session_start(tiles, window, keys):
    """Mark every tile with its session's first time; a key's tiles meet in one task."""
    by_time = Over.partitionBy(*keys).orderBy("_tile")
    opens = F.col("_previous").isNull() | (
        F.col("_first") > F.col("_previous") + interval(window.size))
    so_far = by_time.rowsBetween(Over.unboundedPreceding, Over.currentRow)
    return (tiles.withColumn("_previous", F.lag("_last").over(by_time))
            .withColumn("_opens", F.when(opens, F.col("_first")))
            .withColumn("window_start", F.last("_opens", ignorenulls=True).over(so_far))
            .drop("_previous", "_opens"))


def _sessions(df, ts, window, keys, aggs):
    tiles = _with_session_start(_tiles(df, ts, window, keys, aggs), window, keys)
    grouped = tiles.groupBy(*keys, "window_start").agg(
        (F.max("_last") + interval(window.size)).alias("window_end"),
        *[a.over_slices() for a in aggs])
    return grouped.select(*BOUNDS, *keys, *[a.name for a in aggs])


def with_session(df: DataFrame, ts: str, window: Window, keys: list[str]) -> DataFrame:
    """Every row with the ``window_start`` of its session.

    Rows join the tiles on key and tile, so a hot key's rows spread over its tiles.
    """
    tiles = _with_session_start(_tiles(df, ts, window, keys, []), window, keys)
    tiles = tiles.select(F.struct(*keys).alias("_group"), "_tile", "window_start")
    rows = _tiled(df, ts, window).withColumn("_group", F.struct(*keys))
    return rows.join(tiles, ["_group", "_tile"]).drop("_group", "_tile")


def retained(result: DataFrame, newest: Column, retention: str) -> DataFrame:
    """Windows that end after ``newest`` minus the retention."""
    return result.where(F.col("window_end") > newest - interval(retention))


def distinct_per_window(df: DataFrame, ts: str, window: Window, keys: list[str],
                        value: str) -> DataFrame:
    """Each (window, key, value) once, ready to be counted.

    Works on streams, where Spark has no exact distinct count: the state is spread
    by value, not gathered per group. For sessions, take :func:`with_session` and
    ``distinct``.
    """
    if window.kind == "session":
        raise ValueError("session windows have no bounds before they are aggregated")
    if df.isStreaming:
        df = df.withWatermark(ts, _interval(window.grace))
    rows = df.where(F.col(value).isNotNull()).select(
        window.over(ts).alias("_w"), *keys, value)
    if df.isStreaming:
        rows = rows.dropDuplicates(["_w", *keys, value])
    else:
        rows = rows.distinct()
    return rows.select(F.col("_w.start").alias("window_start"),
                       F.col("_w.end").alias("window_end"), *keys, value)
