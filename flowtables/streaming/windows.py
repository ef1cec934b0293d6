"""Windowed tables kept from streams: open sessions, panes, strict grace and retention.

Spark emits a session only when it is closed, tests late rows one batch too late and deletes no
result. These sinks aggregate each micro-batch before its shuffle, merge the result with what
their last commit holds, and commit changes, state and watermark together.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window as Over
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowtables.operators import windows as W
from flowtables.operators.aggregates import Agg
from flowtables.streaming.changes import DELETED, TableLog
from flowtables.streaming.runs import UNTIL_DONE, run_batches
from flowtables.streaming.versions import Part, Version, VersionedTable, compacted


def _micros(time: timedelta) -> int:
    return time // timedelta(microseconds=1)


def _slice_columns(aggs: list[Agg]) -> list[str]:
    return [f"_{a.name}_{part}" for a in aggs for part in a.slices]


def _resliced(aggs: list[Agg]):
    return [column for a in aggs for column in a.slices_of_slices()]


def _on_time(rows: DataFrame, ts: str, reach, watermark: int | None) -> DataFrame:
    """Rows whose windows end after the watermark (microseconds) of the batches before this one."""
    rows = rows.where(F.col(ts).isNotNull())
    return rows if watermark is None else rows.where(
        F.unix_micros(F.col(ts) + reach) > watermark)


def _after(version: Version, newest, grace: timedelta) -> dict:
    """The notes of the next commit: the newest event and the watermark behind it."""
    known = version.notes.get("newest")
    newest = max((t for t in (known, newest) if t is not None), default=None)
    return {"newest": newest, "watermark": None if newest is None else newest - _micros(grace)}


class SessionTable:
    """Sessions of a stream, the open ones included, as a table that changes with every batch.

    State is one row per session that an event may still reach, with its aggregates in slices.
    A batch is cut into tiles of the gap's length first, so a hot key brings at most one row per
    tile. Tiles and the open sessions of their keys are merged where they are no further apart
    than the gap. A session that has grown is put; if it took in others or starts earlier than
    before, the starts that are gone are deleted.

    A row counts unless its own session would end at or before the watermark, which is the
    newest event of the batches before minus the grace. A session leaves the state one gap after
    it is closed, as no row that counts can reach it then; state is bounded by grace and gap.
    Null times belong to no session.
    """

    def __init__(self, spark: SparkSession, folder: str, rows: T.StructType, ts: str,
                 window: W.Window, keys: list[str], aggs: list[Agg]):
        if window.kind != "session":
            raise ValueError("only session windows have open sessions")
        self.spark, self.ts, self.window, self.keys, self.aggs = spark, ts, window, keys, aggs
        empty = spark.createDataFrame([], T.StructType(
            [T.StructField(f.name, f.dataType) for f in rows]))
        tiles = self._tiles(empty)
        sessions = self._merged(tiles, None)
        self.tile_schema = tiles.schema
        self.state_schema = self._state(sessions).schema
        self.log = TableLog(spark, folder, self._put(sessions).drop(DELETED).schema,
                            [*keys, "window_start"])

    def _tiles(self, rows: DataFrame) -> DataFrame:
        return W._tiles(rows, self.ts, self.window, self.keys, self.aggs).drop("_tile")

    def _merged(self, tiles: DataFrame, opened: DataFrame | None) -> DataFrame:
        """Sessions of the tiles and the open sessions of their keys; ``_fresh`` if a tile is in."""
        both = tiles.withColumn("_start", F.lit(None).cast("timestamp"))
        if opened is not None:
            both = both.unionByName(opened)
        by_time = Over.partitionBy(*self.keys).orderBy("_first")
        reached = F.max("_last").over(by_time.rowsBetween(Over.unboundedPreceding, -1))
        opens = reached.isNull() | (F.col("_first") > reached + W.interval(self.window.size))
        numbered = (both.withColumn("_opens", F.when(opens, 1).otherwise(0))
                    .withColumn("_number", F.sum("_opens").over(by_time)))
        return numbered.groupBy(*self.keys, "_number").agg(
            F.min("_first").alias("_first"), F.max("_last").alias("_last"),
            F.array_compact(F.collect_list("_start")).alias("_starts"),
            F.bool_or(F.col("_start").isNull()).alias("_fresh"),
            *[a.over_slices() for a in self.aggs], *_resliced(self.aggs)).drop("_number")

    def _put(self, sessions: DataFrame) -> DataFrame:
        return sessions.select(
            F.col("_first").alias("window_start"),
            (F.col("_last") + W.interval(self.window.size)).alias("window_end"),
            *self.keys, *[a.name for a in self.aggs], F.lit(False).alias(DELETED))

    def _gone(self, sessions: DataFrame) -> DataFrame:
        """Deletes of the starts that a session had before and has no longer."""
        starts = sessions.select(*self.keys, "_first", F.explode("_starts").alias("window_start"))
        gone = starts.where(F.col("window_start") != F.col("_first")).withColumn(DELETED, F.lit(True))
        missing = [f for f in self.log.table_schema if f.name not in gone.columns]
        return gone.drop("_first").withColumns(
            {f.name: F.lit(None).cast(f.dataType) for f in missing})

    def _state(self, sessions: DataFrame) -> DataFrame:
        return sessions.select(*self.keys, F.col("_first").alias("_start"), "_first", "_last",
                               *_slice_columns(self.aggs))

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Merge one micro-batch; a batch that is committed already is left as it is."""
        versions, version = self.log.versions, self.log.versions.current()
        if self.log.done(version, batch_id):
            return
        gap = W.interval(self.window.size)
        rows = _on_time(batch, self.ts, gap, version.notes.get("watermark"))
        drafts = [versions.write(self._tiles(rows), kind="draft")]  # the batch is read once
        tiles = versions.read(self.tile_schema, (drafts[0],))
        opened = versions.read(self.state_schema, version.of("state"))
        group = F.struct(*self.keys)
        touched = tiles.select(group.alias("_group")).distinct()
        opened = opened.withColumn("_group", group)
        merged = self._merged(tiles, opened.join(touched, "_group", "left_semi").drop("_group"))
        drafts.append(versions.write(merged, kind="draft"))
        merged = versions.read(merged.schema, (drafts[1],))
        newest = merged.agg(F.max(F.unix_micros("_last"))).first()[0]
        notes = _after(version, newest, W.duration(self.window.grace))
        alive = self._state(merged).unionByName(
            opened.join(touched, "_group", "left_anti").drop("_group"))
        if notes["watermark"] is not None:
            alive = alive.where(F.unix_micros(F.col("_last") + gap + gap) > notes["watermark"])
        fresh = merged.where("_fresh")
        self.log.append(version, batch_id, self._put(fresh).unionByName(self._gone(fresh)), alive, **notes)
        for draft in drafts:
            versions.discard(draft)

    def run(self, stream: DataFrame, trigger: dict = UNTIL_DONE) -> StreamingQuery:
        return run_batches(stream, self.update, self.log.versions.folder, trigger)

    def table(self, version: Version | None = None) -> DataFrame:
        """All sessions so far, open and closed."""
        return self.log.table(version)

    def open_sessions(self) -> DataFrame:
        """The state: sessions that an event may still reach."""
        return self.log.versions.read(self.state_schema, self.log.versions.current().of("state"))


def pane_windows(stream: DataFrame, ts: str, window: W.Window, keys: list[str],
                 aggs: list[Agg]) -> DataFrame:
    """Hopping windows of a stream through panes: two stateful aggregates, for append mode.

    The first aggregates rows into panes that no window cuts through, so a row is in one row of
    its state, not in one per window; the second aggregates closed panes into their windows.
    """
    if window.kind != "hopping" or window.retention:
        raise ValueError("panes belong to hopping windows without a retention")
    panes = (stream.withWatermark(ts, W._interval(window.grace))
             .groupBy(F.window(ts, W._pane(window)).alias("_pane"), *keys)
             .agg(*[column for a in aggs for column in a.per_slice()]))
    over = F.window(F.col("_pane"), W._interval(window.size), W._interval(window.advance))
    grouped = panes.groupBy(over.alias("_w"), *keys).agg(*[a.over_slices() for a in aggs])
    return grouped.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
                          *keys, *[a.name for a in aggs])


class WindowTable:
    """Tumbling or hopping windows of a stream with a strict grace and a retention that deletes.

    Nothing is kept in Spark's state: a batch adds its own slices per window, levels of runs are
    merged, and reading merges what is left. The commit holds the watermark, and rows are tested
    against that of the batches before theirs, so a row is dropped in the batch in which it is
    late, also after a restart. Runs are kept by the ``period`` of their windows' ends; a run
    whose windows have all ended before the newest event minus the retention is dropped from the
    commit, its files a few versions later, and rows for windows that are past it are refused.
    """

    def __init__(self, spark: SparkSession, folder: str, rows: T.StructType, ts: str,
                 window: W.Window, keys: list[str], aggs: list[Agg], period: str = "24 HOURS"):
        if window.kind == "session":
            raise ValueError("session windows are kept by a SessionTable")
        self.spark, self.ts, self.window, self.keys, self.aggs = spark, ts, window, keys, aggs
        self.period = _micros(W.duration(period))
        self.versions = VersionedTable(spark, folder)
        empty = spark.createDataFrame([], T.StructType(
            [T.StructField(f.name, f.dataType) for f in rows]))
        self.schema = self._sliced(empty).schema

    def _sliced(self, rows: DataFrame) -> DataFrame:
        grouped = rows.groupBy(self.window.over(self.ts).alias("_w"), *self.keys).agg(
            *[column for a in self.aggs for column in a.per_slice()])
        return grouped.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
                              *self.keys, *_slice_columns(self.aggs))

    def _merged(self, rows: DataFrame, oldest: bool) -> DataFrame:
        return rows.groupBy(*W.BOUNDS, *self.keys).agg(*_resliced(self.aggs)).select(*self.schema.names)

    def _horizon(self, newest: int | None) -> int | None:
        """Windows that end at or before this time are past the retention."""
        if newest is None or self.window.retention is None:
            return None
        return newest - _micros(W.duration(self.window.retention))

    def update(self, batch: DataFrame, batch_id: int) -> None:
        version = self.versions.current()
        if version.notes.get("batch_id", -1) >= batch_id:
            return
        rows = batch.where(F.col(self.ts).isNotNull())
        newest = rows.agg(F.max(F.unix_micros(self.ts))).first()[0]
        notes = _after(version, newest, W.duration(self.window.grace))
        end = F.unix_micros("window_end")
        slices = self._sliced(rows)
        if version.notes.get("watermark") is not None:  # a window is closed, not a row late, one by one
            slices = slices.where(end > version.notes["watermark"])
        horizon = self._horizon(notes["newest"])
        if horizon is not None:
            slices = slices.where(end > horizon)
        draft = self.versions.write(slices, kind="draft")
        slices = self.versions.read(self.schema, (draft,))
        periods = [row[0] for row in slices.select(
            F.floor((end - 1) / self.period).alias("p")).distinct().collect()]  # spans of time, not rows
        added = tuple(self.versions.write(slices.where(F.floor((end - 1) / self.period) == period),
                                          kind="rows", period=period) for period in sorted(periods))
        kept = tuple(part for part in version.parts
                     if horizon is None or (part.period + 1) * self.period > horizon)
        version = self.versions.commit(version, (*kept, *added), batch_id=batch_id, **notes)
        self.versions.discard(draft)
        compacted(self.versions, version, "rows", self.schema, self._merged)

    def run(self, stream: DataFrame, trigger: dict = UNTIL_DONE) -> StreamingQuery:
        return run_batches(stream, self.update, self.versions.folder, trigger)

    def parts(self) -> tuple[Part, ...]:
        return self.versions.current().parts

    def table(self, version: Version | None = None) -> DataFrame:
        """The windows within the retention as of the newest event."""
        version = version or self.versions.current()
        rows = self.versions.read(self.schema, version.of("rows"))
        horizon = self._horizon(version.notes.get("newest"))
        if horizon is not None:
            rows = rows.where(F.unix_micros("window_end") > horizon)
        return rows.groupBy(*W.BOUNDS, *self.keys).agg(*[a.over_slices() for a in self.aggs])
