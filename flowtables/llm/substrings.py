"""Removal of repeated word sequences by fixed-block anchors.

Each document is a reference with its non-overlapping blocks of half a window, and a probe
with every rolling window of that length. A repeat of a whole window holds a block of the
reference, so an equal hash of block and probe marks where to look. Around the hits the
windows themselves are compared, which extends the hits to maximal exact repeats.

Hashes travel packed: a row is one batch's share of a bucket of the hash space, so a window
costs a few bytes of shuffle, and tasks read their buckets as a stream.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables.llm.shingles import hashes, lists, mix, slices, windows, words
from flowtables.session import written

#: Kinds of packed rows, in the order in which a task must see them.
INDEX, PROBE, OWNER = 0, 1, 2
PACKED = "bucket int, kind int, keys binary, low binary, high binary, docs binary, counts binary"
FOUND = "doc_id long, version long, owner boolean, places binary"
#: Entries gathered before an index is brought down to one per key.
GATHERED = 1 << 21


class Packer:
    """Cuts (key, place, document) arrays of a batch into one packed row per bucket."""

    def __init__(self, buckets: int, key_type: str):
        self.buckets, self.key_type = np.uint64(buckets), key_type

    def rows(self, kind: int, keys: np.ndarray, places: np.ndarray, owner: np.ndarray,
             documents: np.ndarray) -> Iterator[tuple]:
        """``owner`` are rows of ``documents``, which holds an id and a version per document."""
        bucket = ((keys >> np.uint64(32)) % self.buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=int(self.buckets)))
        start = 0
        for number, end in enumerate(ends):
            if end > start:
                own = order[start:end]
                changes = np.flatnonzero(np.diff(owner[own], prepend=-1))
                at = places[own].astype(np.uint32)
                yield (number, kind, keys[own].astype(self.key_type).tobytes(),
                       at.astype("<u2").tobytes(), (at >> 16).astype("<u2").tobytes(),
                       documents[owner[own][changes]].tobytes(),
                       np.diff(np.append(changes, len(own))).astype("<u4").tobytes())
            start = end


def packed_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names = ["bucket", "kind", "keys", "low", "high", "docs", "counts"]
    types = [pa.int32(), pa.int32()] + [pa.binary()] * 5
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 2 * len(row[2])
        if size > 16 << 20:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


class Smallest:
    """Per key the smallest document id; memory grows with the distinct keys only."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys, self.ids = [], []
        self.held = 0

    def add(self, keys: np.ndarray, ids: np.ndarray) -> None:
        self.keys.append(keys)
        self.ids.append(ids)
        self.held += len(keys)
        if self.held > GATHERED and len(self.keys) > 1:
            self.settle()
            self.held = len(self.keys[0]) // 2  # settle again when it has grown by half

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) != 1 or self.held >= 0:
            keys = np.concatenate(self.keys) if self.keys else np.zeros(0, np.uint64)
            ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int64)
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
            self.keys, self.ids, self.held = [keys[first]], [ids[first]], -1
        return self.keys[0], self.ids[0]


def answer(key_type: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams buckets: index rows build the table of smallest owners, probe rows are answered
    where the owner is smaller, owner rows where a probe asked for them."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, index, asked = None, Smallest(), None
        found: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                bucket, kind, keys, low, high, docs, counts = row
                if bucket != current:
                    current, asked = bucket, None
                    index.clear()
                keys = np.frombuffer(keys, key_type).astype(np.uint64)
                documents = np.frombuffer(docs, np.int64).reshape(-1, 2)
                counts = np.frombuffer(counts, "<u4").astype(np.int64)
                ids = np.repeat(documents[:, 0], counts)
                if kind == INDEX:
                    index.add(keys, ids)
                    continue
                known, smallest = index.settle()
                if not len(known):
                    continue
                if asked is None:
                    asked = np.zeros(len(known), bool)
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                if kind == PROBE:
                    good = (known[at] == keys) & (smallest[at] < ids)
                    asked[at[good]] = True
                else:
                    good = (known[at] == keys) & asked[at]
                if not good.any():
                    continue
                places = (np.frombuffer(low, "<u2").astype(np.uint32)
                          | (np.frombuffer(high, "<u2").astype(np.uint32) << 16))[good]
                owners = np.repeat(np.arange(len(counts)), counts)[good]
                starts = np.flatnonzero(np.diff(owners, prepend=-1))
                for start, end in zip(starts, np.append(starts[1:], len(owners))):
                    document = documents[owners[start]]
                    found.append((int(document[0]), int(document[1]), kind == OWNER,
                                  places[start:end].astype("<u4").tobytes()))
                    held += 40 + 4 * int(end - start)
                if held > 16 << 20:
                    yield found_batch(found)
                    found, held = [], 0
        if found:
            yield found_batch(found)

    return stream


def found_batch(found: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)],
                                      ["doc_id", "version", "owner", "places"])


def by_bucket(packed: DataFrame, buckets: int) -> DataFrame:
    """One task per bucket, its rows in the order of their kinds."""
    return packed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind")


def places(lists_of_places: pa.Array) -> np.ndarray:
    """The joined places of one row's list of binaries."""
    return np.frombuffer(b"".join(lists_of_places), "<u4").astype(np.int64)


def anchor_rows(size: int, buckets: int):
    """Packs blocks and rolling windows of ``size`` words; texts below two blocks have no window."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            packer = Packer(buckets, "<u4")
            for batch in slices(batches):
                values, starts = lists(batch.column("words"))
                documents = np.column_stack([np.asarray(batch.column("doc_id"), np.int64),
                                             np.asarray(batch.column("version"), np.int64)])
                if len(values) < size:
                    continue
                rolled = windows(values, size)
                counts = np.maximum(np.diff(starts) - size + 1, 0)
                owner = np.repeat(np.arange(len(counts)), counts)
                at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                keys = rolled[starts[:-1][owner] + at]
                blocks = at % size == 0
                for kind in (INDEX, OWNER):
                    yield from packer.rows(kind, keys[blocks], at[blocks], owner[blocks], documents)
                yield from packer.rows(PROBE, keys, at, owner, documents)

        yield from packed_batches(rows())

    return pack


def window_rows(size: int, buckets: int):
    """Packs the windows of two blocks that hold a hit: a probe's, and those of hit blocks."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            packer = Packer(buckets, "<u8")
            for batch in slices(batches):
                values, starts = lists(batch.column("words"))
                documents = np.column_stack([np.asarray(batch.column("doc_id"), np.int64),
                                             np.asarray(batch.column("version"), np.int64)])
                for kind, name in ((INDEX, "owned"), (PROBE, "asked")):
                    keys, at, owner = [], [], []
                    for row, hits in enumerate(batch.column(name).to_pylist()):
                        own = values[starts[row]:starts[row + 1]]
                        count = len(own) - 2 * size + 1
                        if not hits or count <= 0:
                            continue
                        # A window holds the block at p if it starts in [p - size, p].
                        hit = places(hits)
                        edge = np.zeros(len(own) + 2, np.int64)
                        np.add.at(edge, np.maximum(hit - size, 0), 1)
                        np.add.at(edge, np.minimum(hit, len(own)) + 1, -1)
                        chosen = np.flatnonzero(np.cumsum(edge)[:count])
                        rolled = windows(own, 2 * size)[chosen]
                        keys.append(mix(rolled))
                        at.append(chosen)
                        owner.append(np.full(len(chosen), row))
                    if keys:
                        yield from packer.rows(kind, np.concatenate(keys), np.concatenate(at),
                                               np.concatenate(owner), documents)

        yield from packed_batches(rows())

    return pack


def cover(window: int):
    @F.arrow_udf("kept string, removed long")
    def kept(texts: pa.Array, found: pa.Array) -> pa.Array:
        rows = []
        for tokens, hits in zip(texts.to_pylist(), found.to_pylist()):
            if hits is None or tokens is None:
                rows.append(None)
                continue
            edge = np.zeros(len(tokens) + window + 1, np.int64)
            at = places(hits)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            left = np.flatnonzero(np.cumsum(edge)[:len(tokens)] == 0)
            rows.append({"kept": " ".join([tokens[i] for i in left]),
                         "removed": len(tokens) - len(left)})
        return pa.array(rows, pa.struct([("kept", pa.string()), ("removed", pa.int64())]))

    return kept


def release(spark) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that are no longer in use."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   window: int = 50, kept: str = "kept_text", n_words: str = "n_words",
                   n_removed: str = "n_removed", bucket_words: int = 1 << 22,
                   least_buckets: int = 32) -> DataFrame:
    """``documents`` without words covered by a ``window`` of words (an even number) that also
    starts in a document with a smaller id; judged on the whole input texts.

    Adds the kept words joined by a space, the number of words and of removed words. Null and
    empty texts have no words. Rows without an id neither lose words nor make others lose them;
    rows with equal ids do not affect each other; columns named as results are replaced; an
    empty table gives no rows. Words are compared by 64-bit hashes, windows by 64-bit hashes
    within a bucket.

    Every rolling window is probed, whatever its frequency: a task keeps one number per
    distinct key and streams the rest, so a passage of a third of all documents takes time in
    one task, not memory. ``bucket_words`` is the number of windows per task; there are
    ``least_buckets`` tasks at least. Documents meet
    their hits by joins on (id, hash of the text), which are unique but for repeated rows.
    """
    if window % 2:
        raise ValueError("the window must be an even number of words")
    size, spark = window // 2, documents.sparkSession
    own = words(F.col(text))
    version = F.xxhash64(F.col(text))
    keyed = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"), version.alias("version"),
        F.col(text).alias("text"))
    total = documents.agg(F.sum(F.length(F.col(text)))).first()[0] or 0
    buckets = max(1, -(-total // (6 * bucket_words)))  # about six characters a word
    spread = max(buckets, least_buckets)

    long = keyed.withColumn("words", hashes(words(F.col("text")))).where(F.size("words") >= window)
    probed = by_bucket(long.select("doc_id", "version", "words")
                       .mapInArrow(anchor_rows(size, spread), PACKED), spread)
    hits = written(probed.mapInArrow(answer("<u4"), FOUND), "repeats")
    del probed
    release(spark)

    def listed(owner: bool) -> F.Column:
        return F.collect_list(F.when(F.col("owner") == owner, F.col("places")))

    grouped = hits.groupBy("doc_id", "version").agg(listed(False).alias("asked"),
                                                    listed(True).alias("owned"))
    near = (keyed.join(grouped, ["doc_id", "version"])
            .select("doc_id", "version", hashes(words(F.col("text"))).alias("words"), "asked", "owned"))
    compared = by_bucket(near.mapInArrow(window_rows(size, spread), PACKED), spread)
    covered = written(compared.mapInArrow(answer("<u8"), FOUND).groupBy("doc_id", "version")
                      .agg(F.collect_list("places").alias("_covered")), "repeats")
    del near, compared, grouped
    release(spark)

    covered = covered.withColumnsRenamed({"doc_id": "_doc_id", "version": "_version"})
    result = documents.drop(*({kept, n_words, n_removed} - {doc_id, text}))
    result = result.join(covered, (F.col(doc_id).cast("long") == F.col("_doc_id"))
                         & (version == F.col("_version")), "left")
    affected = F.when(F.col("_covered").isNotNull(), own)
    result = result.withColumn("_kept", cover(window)(affected, F.col("_covered")))
    return result.withColumns({
        n_words: F.size(own).cast("long"),
        n_removed: F.coalesce(F.col("_kept.removed"), F.lit(0).cast("long")),
        kept: F.coalesce(F.col("_kept.kept"), F.array_join(own, " ")),
    }).drop("_kept", "_covered", "_doc_id", "_version")
