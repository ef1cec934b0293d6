"""Tables named by a small manifest that is committed in one step.

A version lists the parts (folders of Parquet files) that make up the table and a few notes of
its writer, such as the last micro-batch and the watermark. Readers take the newest version and
read its parts; a writer adds parts beside them and then publishes the next version. A reader
therefore sees all of a commit or nothing of it, and a micro-batch that runs again after its
commit is recognised by its number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from py4j.protocol import Py4JJavaError

from flowtables.session import file_system

#: Versions whose parts stay for readers that have begun with them.
KEPT_VERSIONS = 10
#: Runs of one level that are merged into a run of the next one.
FANOUT = 4


@dataclass(frozen=True)
class Part:
    """A folder of rows: what they are for, their level, and the period they belong to."""

    path: str
    kind: str = "rows"
    level: int = 0
    period: int | None = None


@dataclass(frozen=True)
class Version:
    number: int = 0
    parts: tuple[Part, ...] = ()
    notes: dict = field(default_factory=dict)

    def of(self, kind: str) -> tuple[Part, ...]:
        return tuple(part for part in self.parts if part.kind == kind)


class Conflict(RuntimeError):
    """Another writer has published the version first."""


class VersionedTable:
    """The versions of one folder; it has one writer at a time and any number of readers."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = KEPT_VERSIONS):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _manifest(self, number: int) -> str:
        return f"{self.folder}/_versions/{number:012d}.json"

    def _load(self, number: int) -> Version:
        path, files = file_system(self.spark, self._manifest(number))
        stream = files.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        content = json.loads(text)
        return Version(number, tuple(Part(**part) for part in content["parts"]), content["notes"])

    def current(self) -> Version:
        """The newest version; version 0 without parts if there is none."""
        path, files = file_system(self.spark, f"{self.folder}/_versions")
        if not files.exists(path):
            return Version()
        numbers = [int(name[:-5]) for name in (status.getPath().getName() for status in files.listStatus(path))
                   if name.endswith(".json")]
        return self._load(max(numbers)) if numbers else Version()

    def write(self, df: DataFrame, **about) -> Part:
        """Write rows as a part that no version names yet."""
        part = Part(f"data/{uuid.uuid4().hex}", **about)
        df.write.parquet(f"{self.folder}/{part.path}")
        return part

    def discard(self, part: Part) -> None:
        """Delete a part that no version names."""
        path, files = file_system(self.spark, f"{self.folder}/{part.path}")
        files.delete(path, True)

    def read(self, schema: T.StructType, parts: tuple[Part, ...]) -> DataFrame:
        """The rows of some parts; no parts are an empty table."""
        if not parts:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.folder}/{part.path}" for part in parts]
        return self.spark.read.schema(schema).parquet(*paths)

    def commit(self, base: Version, parts: tuple[Part, ...], **notes) -> Version:
        """Publish the version after ``base``; parts of versions too old to be read are deleted."""
        version = Version(base.number + 1, tuple(parts), {**base.notes, **notes})
        content = {"parts": [asdict(part) for part in version.parts], "notes": version.notes}
        if not self._publish(self._manifest(version.number), json.dumps(content)):
            raise Conflict(f"version {version.number} of {self.folder} exists already")
        self._expire(version.number - self.keep)
        return version

    def _publish(self, target: str, text: str) -> bool:
        """Create a file with all of its content; False if it is there already."""
        jvm = self.spark._jvm
        draft, files = file_system(self.spark, f"{target}.{uuid.uuid4().hex}")
        files.mkdirs(draft.getParent())
        stream = files.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        final = file_system(self.spark, target)[0]
        renames = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(renames, 1)
        options[0] = renames.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            files.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(files.makeQualified(draft), files.makeQualified(final), options)
        except (Py4JJavaError, PySparkException):
            files.delete(draft, False)
            if files.exists(final):
                return False
            raise
        return True

    def _expire(self, number: int) -> None:
        """Delete a version and the parts that no later one names: a part never comes back."""
        path, files = file_system(self.spark, self._manifest(number))
        if number < 1 or not files.exists(path):
            return
        after = {part.path for part in self._load(number + 1).parts}
        for part in self._load(number).parts:
            if part.path not in after:
                files.delete(file_system(self.spark, f"{self.folder}/{part.path}")[0], True)
        files.delete(path, False)


def replace_version(df: DataFrame, folder: str, keep: int = KEPT_VERSIONS) -> Version:
    """Replace the table in ``folder`` in one step: readers see the old rows or the new ones."""
    table = VersionedTable(df.sparkSession, folder, keep)
    return table.commit(table.current(), (table.write(df),))


def read_version(spark: SparkSession, folder: str, schema: T.StructType,
                 version: Version | None = None) -> DataFrame:
    """The table in ``folder``, pinned to its newest version or to the one given.

    The frame can be used until ``KEPT_VERSIONS`` further versions are published.
    """
    table = VersionedTable(spark, folder)
    return table.read(schema, (version or table.current()).of("rows"))


def replace_stream(start: Callable[[str], None], spark: SparkSession, folder: str) -> Version:
    """Replace a relation that a stream keeps: the successor is filled first, then put in place.

    ``start`` runs the successor's stream into the folder it is given until it has read what
    there is; its checkpoint lies beside it, so the stream goes on from there afterwards. Until
    the commit all readers see the relation of the old stream.
    """
    table = VersionedTable(spark, folder)
    part = Part(f"data/{uuid.uuid4().hex}")
    start(f"{table.folder}/{part.path}")
    return table.commit(table.current(), (part,))


def compacted(table: VersionedTable, version: Version, kind: str, schema: T.StructType,
              merge: Callable[[DataFrame, bool], DataFrame], fanout: int = FANOUT) -> Version:
    """Merge runs of one level and period as long as there are ``fanout`` of them.

    After n batches at most ``fanout`` runs of each of log(n) levels are left, and a row is
    rewritten once per level. ``merge`` gets the rows and whether they hold the oldest run of
    their period, so that nothing is left for a delete to act on. Every merge is one commit, so
    readers may come at any time.
    """
    while True:
        runs: dict[tuple, list[Part]] = {}
        for part in version.of(kind):
            runs.setdefault((part.period, part.level), []).append(part)
        full = [(key, parts) for key, parts in runs.items() if len(parts) >= fanout]
        if not full:
            return version
        (period, level), parts = min(full, key=lambda run: run[0][1])
        oldest = not any(p == period and below > level for p, below in runs)
        rows = merge(table.read(schema, tuple(parts)), oldest)
        merged = replace(table.write(rows, kind=kind, period=period), level=level + 1)
        # A run takes the place of the first one it is made of, so runs stay in order of time.
        at = version.parts.index(parts[0])
        rest = [part for part in version.parts if part not in parts]
        version = table.commit(version, (*rest[:at], merged, *rest[at:]))
