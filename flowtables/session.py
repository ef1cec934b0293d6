"""Session settings and the shared folder for intermediate tables.

Everything that cuts lineage or holds stream state is written below the folder
the cluster names in ``spark.checkpoint.dir``, so a lost executor costs a
re-read, never a result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot key's events of a micro-batch are merged into sessions before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Large state lives on disk next to the executor, not on its heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


LOCAL_FOLDER = "flowtables.local.folder"


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints; a temporary one only for local runs."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = spark.conf.get(LOCAL_FOLDER, None)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="flowtables-")
        spark.conf.set(LOCAL_FOLDER, folder)
    return folder


def session_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_folder(spark)}/flowtables/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing path below the shared folder."""
    return f"{session_folder(spark)}/{label}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """A path and its file system, whichever store it is in."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, files = file_system(spark, path)
    return files.exists(hadoop)


def make_folder(spark: SparkSession, path: str) -> None:
    """An empty folder, unless there is one."""
    hadoop, files = file_system(spark, path)
    files.mkdirs(hadoop)


def clear_intermediate(spark: SparkSession) -> None:
    """Remove what this session's operators have written to the shared folder.

    Call it when results have been used: a result reads intermediate tables until then.
    Sinks and topics that a caller has placed elsewhere stay.
    """
    hadoop, files = file_system(spark, session_folder(spark))
    files.delete(hadoop, True)


def replace_table(df: DataFrame, folder: str) -> None:
    """Replace the table in ``folder``: written beside it first, then swapped.

    A reader that starts between the two renames finds no table, never half of one; a
    failed write leaves the old one. A stream that writes into ``folder`` needs a new
    checkpoint afterwards.
    """
    spark = df.sparkSession
    fresh, old = f"{folder}.new-{uuid.uuid4().hex}", f"{folder}.old-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    target, files = file_system(spark, folder)
    if files.exists(target):
        files.rename(target, file_system(spark, old)[0])
    files.rename(file_system(spark, fresh)[0], target)
    files.delete(file_system(spark, old)[0], True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it.

    The plan restarts at the files, and the planner sees their real size, so it
    broadcasts the table only where that size is below its threshold.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
