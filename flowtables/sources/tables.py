"""Parquet tables and the event stream over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtables.session import file_system


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str, ts: str | None = None,
                 **options: str) -> DataFrame:
    """A table's files as a stream. ``ts`` is made a TIMESTAMP, as watermarks need one.

    A table is one file or a folder of part files, as in a batch.
    """
    table = read_table(spark, folder, name)
    path, files = file_system(spark, f"{folder}/{name}.parquet")
    single = files.getFileStatus(path).isFile()
    if not single and not _holds_files(files, path):
        raise ValueError(f"{folder}/{name}.parquet holds no files to stream")
    reader = spark.readStream.schema(table.schema).options(**options)
    if single:
        stream = reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    else:
        stream = reader.parquet(f"{folder}/{name}.parquet")
    return stream.withColumn(ts, F.col(ts).cast("timestamp")) if ts else stream


def _holds_files(files, path) -> bool:
    """Whether a folder has a data file; the listing ends at the first one."""
    found = files.listFiles(path, True)
    while found.hasNext():
        if not found.next().getPath().getName().startswith(("_", ".")):
            return True
    return False
