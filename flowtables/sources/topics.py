"""Topics: named storage of keyed, serialised records.

A record has a ``key`` and a ``value`` column. In production a topic is a Kafka
topic; a folder of text files, one value per line, serves as well. Both give the
same record frames, and :func:`declare_source` turns those into typed columns.
"""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtables.functions.formats import decoded, encode
from flowtables.session import file_system, make_folder
from flowtables.streaming.versions import VersionedTable

START_POSITIONS = ("earliest", "latest")


def folder_records(spark: SparkSession, folder: str, stream: bool = True, keyed: bool = False,
                   **options: str) -> DataFrame:
    """Records of a folder topic; ``options`` go to the reader (maxFilesPerTrigger, ...).

    A ``keyed`` topic was written with keys: its lines are JSON objects of key and value.
    """
    reader = spark.readStream if stream else spark.read
    lines = reader.options(**options).text(folder)
    if not keyed:
        return lines
    return lines.select(F.from_json("value", "key string, value string").alias("r")).select("r.*")


def kafka_records(spark: SparkSession, servers: str, topic: str, start: str = "earliest",
                  stream: bool = True, **options: str) -> DataFrame:
    """Records of a Kafka topic with ``partition`` and ``offset`` as arrival order."""
    if start not in START_POSITIONS:
        raise ValueError(f"start position {start!r} is not one of {START_POSITIONS}")
    reader = (spark.readStream if stream else spark.read).format("kafka")
    reader = reader.options(**{"kafka.bootstrap.servers": servers, "subscribe": topic,
                               "startingOffsets": start, **options})
    try:
        records = reader.load()
    except PySparkException as missing:
        if "kafka" in str(missing).lower():
            raise RuntimeError("Kafka topics need Spark's external "
                               "spark-sql-kafka module on the class path") from missing
        raise
    return records.select(F.col("key").cast("string"), F.col("value").cast("string"),
                          "partition", "offset")


def declare_source(records: DataFrame, schema: T.StructType, event_time: str | None = None,
                   pattern: str | None = None, **format_options) -> DataFrame:
    """Typed columns of a topic; ``event_time`` adds the event time as column ``ts``.

    ``event_time`` names a BIGINT column of epoch milliseconds, or with ``pattern``
    a text column.
    """
    rows = decoded(records, schema, **format_options)
    if event_time is None:
        return rows
    if pattern is not None:
        return rows.withColumn("ts", F.try_to_timestamp(event_time, F.lit(pattern)))
    return rows.withColumn("ts", F.timestamp_millis(event_time))


def to_records(df: DataFrame, keys: list[str] | None = None, **format_options) -> DataFrame:
    """``key`` and ``value`` columns of the given rows; the key stays in the value too."""
    value = encode(df.columns, schema=df.schema, **format_options).alias("value")
    if not keys:
        return df.select(value)
    key = F.col(keys[0]).cast("string") if len(keys) == 1 else F.to_json(F.struct(*keys))
    return df.select(key.alias("key"), value)


def write_folder_topic(df: DataFrame, folder: str, keys: list[str] | None = None,
                       **format_options) -> None:
    """Append a batch of rows to a folder topic; with ``keys`` each record keeps its key."""
    records = to_records(df, keys, **format_options)
    if keys:
        records = records.select(F.to_json(F.struct("key", "value")).alias("value"))
    records.write.mode("append").text(folder)


class OffsetTopic:
    """A folder topic whose records have a ``partition`` and an ``offset``, as in Kafka.

    A batch is written as one file per partition. Its rows' offsets are reserved by a commit
    before the files become visible, in a folder named by the first offset; a record's offset is
    that plus its place in the file, so readers need no list of files and a stream reads the
    folder like any other. A failed write leaves a gap in the offsets, never a repeated one.
    """

    def __init__(self, spark: SparkSession, folder: str, partitions: int):
        self.spark, self.folder, self.partitions = spark, folder.rstrip("/"), partitions
        self.versions = VersionedTable(spark, self.folder)
        make_folder(spark, f"{self.folder}/records")

    def append(self, df: DataFrame, keys: list[str], order: list[str] | None = None,
               **format_options) -> None:
        """Append a batch; a key's records are in one partition, in ``order`` within the batch."""
        places = [F.col(name).alias(f"_order{at}") for at, name in enumerate(order or [])]
        key = F.col(keys[0]).cast("string") if len(keys) == 1 else F.to_json(F.struct(*keys))
        value = encode(df.columns, schema=df.schema, **format_options)
        rows = df.select(key.alias("key"), value.alias("value"), *places).withColumn(
            "partition", F.pmod(F.xxhash64("key"), F.lit(self.partitions)).cast("int"))
        draft = f"{self.folder}/drafts/{uuid.uuid4().hex}"
        (rows.repartition(self.partitions, "partition")
         .sortWithinPartitions("partition", *[f"_order{at}" for at in range(len(places))])
         .select("key", "value", "partition").write.partitionBy("partition").parquet(draft))
        counts = {row.partition: row.n for row in self.spark.read.parquet(draft).groupBy("partition")
                  .agg(F.count(F.lit(1)).alias("n")).collect()} if not df.isEmpty() else {}
        version, ends = self.versions.current(), self.ends()
        self.versions.commit(version, (), ends={p: ends.get(p, 0) + counts.get(p, 0)
                                                for p in range(self.partitions)})
        files = file_system(self.spark, self.folder)[1]
        for number in counts:  # one folder per partition that got records
            final = file_system(self.spark, f"{self.folder}/records/partition={number}/first={ends.get(number, 0)}")[0]
            files.mkdirs(final.getParent())
            files.rename(file_system(self.spark, f"{draft}/partition={number}")[0], final)
        files.delete(file_system(self.spark, draft)[0], True)

    def ends(self) -> dict[int, int]:
        """The offset after the last record of each partition: where ``latest`` starts."""
        return {int(p): end for p, end in self.versions.current().notes.get("ends", {}).items()}

    def records(self, start: str | dict[int, int] = "earliest", stream: bool = False,
                **options: str) -> DataFrame:
        """key, value, partition and offset from ``earliest``, ``latest`` or given offsets on.

        ``latest`` is the end of the topic when this is called. A stream that is started again
        must be given the same offsets: take :meth:`ends` once and keep it.
        """
        if start not in START_POSITIONS and not isinstance(start, dict):
            raise ValueError(f"start position {start!r} is not one of {START_POSITIONS}")
        reader = (self.spark.readStream if stream else self.spark.read).options(**options)
        schema = T.StructType.fromDDL("key string, value string, partition int, first bigint")
        rows = reader.schema(schema).parquet(f"{self.folder}/records")
        rows = rows.select("key", "value", "partition",
                           (F.col("first") + F.col("_metadata.row_index")).alias("offset"))
        begins = self.ends() if start == "latest" else {} if start == "earliest" else start
        for number, offset in begins.items():
            rows = rows.where((F.col("partition") != number) | (F.col("offset") >= offset))
        return rows


def kafka_writer(df: DataFrame, servers: str, topic: str, checkpoint: str,
                 keys: list[str], **format_options):
    """Stream writer into a Kafka topic. Kafka places records by key, so rows are
    not shuffled for it."""
    return (to_records(df, keys, **format_options).writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("checkpointLocation", checkpoint))


def merged(*branches: DataFrame) -> DataFrame:
    """Fan-in: rows of all branches by column name, missing columns as null."""
    first, *others = branches
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
