"""Tables kept from streams as logs of puts and deletes in levels.

A :class:`TableLog` takes the changes of one micro-batch per commit, together with what its
writer has to remember. Reading it takes the newest change of each key and leaves out keys
whose newest change is a delete. Runs of changes are merged level by level, so a reader meets
a number of files that grows with the logarithm of the batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowtables.operators.aggregates import first_occurrence, topk, topk_distinct
from flowtables.operators.tables import latest_per_key
from flowtables.streaming.runs import UNTIL_DONE, run_batches
from flowtables.streaming.versions import FANOUT, KEPT_VERSIONS, VersionedTable, Version, compacted

DELETED = "_deleted"


class TableLog:
    """The table behind a change log; ``schema`` is that of its rows, ``keys`` name them."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: list[str],
                 fanout: int = FANOUT, keep: int = KEPT_VERSIONS):
        self.keys, self.fanout = keys, fanout
        self.table_schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        self.schema = T.StructType([*self.table_schema, T.StructField(DELETED, T.BooleanType()),
                                    T.StructField("batch_id", T.LongType())])
        self.versions = VersionedTable(spark, folder, keep)

    def done(self, version: Version, batch_id: int) -> bool:
        return version.notes.get("batch_id", -1) >= batch_id

    def append(self, version: Version, batch_id: int, changes: DataFrame,
               state: DataFrame | None = None, **notes) -> Version:
        """Commit a batch: its changes (rows and ``_deleted``), the writer's new state, its notes."""
        log = self.versions.write(changes.select(*self.table_schema.names, DELETED,
                                                 F.lit(batch_id).cast("long").alias("batch_id")), kind="log")
        parts = (*[part for part in version.parts if state is None or part.kind != "state"], log)
        if state is not None:
            parts = (*parts, self.versions.write(state, kind="state"))
        version = self.versions.commit(version, parts, batch_id=batch_id, **notes)
        return compacted(self.versions, version, "log", self.schema, self._merged, self.fanout)

    def _merged(self, rows: DataFrame, oldest: bool) -> DataFrame:
        newest = latest_per_key(rows, self.keys, F.col("batch_id")).select(*self.schema.names)
        return newest.where(~F.col(DELETED)) if oldest else newest

    def changes(self, version: Version | None = None) -> DataFrame:
        """What is left of the changes: each key's newest one in every run."""
        version = version or self.versions.current()
        return self.versions.read(self.schema, version.of("log"))

    def table(self, version: Version | None = None) -> DataFrame:
        """The rows of the table, as of the newest version or a given one."""
        newest = latest_per_key(self.changes(version), self.keys, F.col("batch_id"))
        return newest.where(~F.col(DELETED)).select(*self.table_schema.names)


class ReducedLog:
    """A table whose batches are each reduced, and whose reductions are reduced again.

    ``reduce`` must give the same from all rows as from the rows that it leaves of each part of
    them: the k largest values, the first row of a key, its newest row. Runs are reduced level by
    level, so what a read meets grows with the logarithm of the batches.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType,
                 reduce: Callable[[DataFrame], DataFrame], fanout: int = FANOUT, keep: int = KEPT_VERSIONS):
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        self.reduce, self.fanout = reduce, fanout
        self.versions = VersionedTable(spark, folder, keep)

    def update(self, batch: DataFrame, batch_id: int) -> None:
        version = self.versions.current()
        if version.notes.get("batch_id", -1) >= batch_id:
            return
        part = self.versions.write(self.reduce(batch).select(*self.schema.names), kind="log")
        version = self.versions.commit(version, (*version.parts, part), batch_id=batch_id)
        compacted(self.versions, version, "log", self.schema,
                  lambda rows, _: self.reduce(rows).select(*self.schema.names), self.fanout)

    def run(self, rows: DataFrame, trigger: dict = UNTIL_DONE) -> StreamingQuery:
        return run_batches(rows, self.update, self.versions.folder, trigger)

    def table(self, version: Version | None = None) -> DataFrame:
        version = version or self.versions.current()
        return self.reduce(self.versions.read(self.schema, version.of("log"))).select(*self.schema.names)


def largest(keys: list[str], value: str, k: int, distinct: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A reduction to the ``k`` largest values of each key, one per row."""
    def reduce(rows: DataFrame) -> DataFrame:
        best = (topk_distinct if distinct else topk)(rows, keys, F.col(value), k, "_best")
        return best.select(*keys, F.explode("_best").alias(value))
    return reduce


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    # One struct as the key joins null keys to null keys with a plain equality.
    return df.withColumn("_group", F.struct(*keys))


def matching_changes(groups: DataFrame, condition: Column, log: TableLog,
                     trigger: dict = UNTIL_DONE) -> StreamingQuery:
    """A filter over an updating aggregate (HAVING), with deletes.

    A batch brings the groups that have changed. Those that match are put. Of the others, those
    that the table holds have stopped matching and are deleted; groups that never matched leave
    no trace. After every batch the table is the filter over all groups so far.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        version = log.versions.current()
        if log.done(version, batch_id):
            batch.write.format("noop").mode("overwrite").save()  # the state still has to follow
            return
        batch = batch.persist()  # one run of the stateful plan serves both sides
        try:
            held = _keyed(log.table(version), log.keys).select("_group")
            gone = _keyed(batch.where(~F.coalesce(condition, F.lit(False))), log.keys).join(
                held, "_group", "left_semi").drop("_group")
            puts = batch.where(condition).withColumn(DELETED, F.lit(False))
            log.append(version, batch_id, puts.unionByName(gone.withColumn(DELETED, F.lit(True))))
        finally:
            batch.unpersist()

    return run_batches(groups, write, log.versions.folder, trigger, "update")


def first_only(rows: DataFrame, order: str, log: TableLog,
               trigger: dict = UNTIL_DONE) -> StreamingQuery:
    """The first row of every key, put once in the batch in which the key comes up.

    Of the rows of that batch the smallest by ``order`` is taken; rows that come later change
    nothing, whatever their order. The keys seen so far are the table itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        version = log.versions.current()
        if log.done(version, batch_id):
            return
        seen = _keyed(log.table(version), log.keys).select("_group")
        new = _keyed(first_occurrence(batch, log.keys, order), log.keys).join(seen, "_group", "left_anti")
        log.append(version, batch_id, new.withColumn(DELETED, F.lit(False)))

    return run_batches(rows, write, log.versions.folder, trigger)


def kept_changes(groups: DataFrame, log: TableLog, trigger: dict = UNTIL_DONE,
                 per_batch: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """A table of puts alone, such as an updating aggregate, with its log kept in levels."""
    def write(batch: DataFrame, batch_id: int) -> None:
        version = log.versions.current()
        if log.done(version, batch_id):
            batch.write.format("noop").mode("overwrite").save()
            return
        rows = per_batch(batch) if per_batch else batch
        log.append(version, batch_id, rows.withColumn(DELETED, F.lit(False)))

    return run_batches(groups, write, log.versions.folder, trigger, "update")
