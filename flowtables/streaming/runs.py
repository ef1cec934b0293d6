"""Stream sinks.

Each sink folder has its checkpoint beside it. ``trigger`` defaults to reading
what is available and stopping, which resumes from the checkpoint on the next
call; pass ``processingTime`` for a query that keeps running.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowtables.operators.tables import latest_per_key
from flowtables.session import exists

UNTIL_DONE = {"availableNow": True}


def _start(writer, folder: str, trigger: dict) -> StreamingQuery:
    query = (writer.option("checkpointLocation", f"{folder}.checkpoint")
             .trigger(**trigger).start())
    if trigger.get("availableNow"):
        query.awaitTermination()
    return query


def run_batches(df: DataFrame, write: Callable[[DataFrame, int], None], folder: str,
                trigger: dict = UNTIL_DONE, mode: str = "append") -> StreamingQuery:
    """Hand every micro-batch and its number to ``write``, with a checkpoint beside ``folder``."""
    return _start(df.writeStream.outputMode(mode).foreachBatch(write), folder, trigger)


def append_rows(df: DataFrame, folder: str, trigger: dict = UNTIL_DONE) -> StreamingQuery:
    """Append each finished row once. A window appears after its grace period."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", folder)
    return _start(writer, folder, trigger)


def append_changes(df: DataFrame, folder: str, trigger: dict = UNTIL_DONE,
                   per_batch: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write every change of a table to a change log, one folder per micro-batch.

    A batch that is run again after it was written is left as it is, so a stream that has
    read its files does not meet them twice; an unfinished one is written anew. ``per_batch``
    may reduce a batch first.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        path = f"{folder}/batch_id={batch_id}"
        if exists(batch.sparkSession, f"{path}/_SUCCESS"):
            batch.write.format("noop").mode("overwrite").save()  # the state still has to follow
            return
        rows = per_batch(batch) if per_batch else batch
        rows.write.mode("overwrite").parquet(path)

    return run_batches(df, write, folder, trigger, "update")


def read_changes(spark: SparkSession, folder: str, schema: T.StructType,
                 stream: bool = False) -> DataFrame:
    """The change log as rows with their ``batch_id``; as a stream if asked."""
    reader = spark.readStream if stream else spark.read
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return reader.schema(with_batch).parquet(folder)


def current_table(changes: DataFrame, keys: list[str],
                  snapshot: DataFrame | None = None) -> DataFrame:
    """The table behind a change log: the newest change of every key.

    With a snapshot only the batches after it are read.
    """
    return _newest(changes, keys, snapshot).drop("batch_id")


def _newest(changes, keys, snapshot):
    if snapshot is not None:
        covered = snapshot.agg(F.max("batch_id")).first()[0]
        if covered is not None:
            # A log's batches are folders, so this skips the covered files.
            changes = snapshot.unionByName(changes.where(F.col("batch_id") > F.lit(covered)))
    return latest_per_key(changes, keys, F.col("batch_id"))


def write_snapshot(changes: DataFrame, keys: list[str], folder: str,
                   snapshot: DataFrame | None = None) -> None:
    """Compact a change log, or the last snapshot and the log after it, into a new folder."""
    _newest(changes, keys, snapshot).write.parquet(folder)


# Later than any event; closes all windows of a stream that is known to be complete.
END_OF_TIME = "9999-01-01 00:00:00"


class EndMarker:
    """Closes the windows of a finished source.

    Append mode emits a window only when a later event moves the watermark past
    it. ``attach`` adds a marker branch to a stream; ``close`` sends one row at
    the end of time through it. That row's own window is never emitted.
    """

    def __init__(self, spark: SparkSession, schema: T.StructType, ts: str, folder: str):
        self.spark, self.folder = spark, folder
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        values = [F.to_timestamp(F.lit(END_OF_TIME)) if f.name == ts else F.lit(None)
                  for f in self.schema]
        self.row = spark.range(1).select(*[
            v.cast(f.dataType).alias(f.name) for v, f in zip(values, self.schema)])
        self.row.where("false").write.parquet(folder)

    def attach(self, stream: DataFrame) -> DataFrame:
        return stream.unionByName(self.spark.readStream.schema(self.schema).parquet(self.folder))

    def close(self) -> None:
        self.row.write.mode("append").parquet(self.folder)
