"""Near-duplicate groups by min-max hashing.

Each permutation is evaluated once and gives two signature values, the minimum and the
maximum, so a signature needs half the evaluations. Bands of the signature propose pairs; a
link needs the given similarity of the full shingle sets; groups are connected components.

Frequent bands are never expanded into all pairs. Their members are compared with one centre
per band first, then with the best linked member. What is still apart after that is
compared where two sets share one of their rarest shingles, as all linked ones do.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtables.llm.components import components, extended
from flowtables.llm.shingles import hashes, lists, mix, shingle_set, words
from flowtables.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Members of a band up to which all its pairs are compared at once. The result does not depend on it.
SMALL = 8
ROUNDS = 1
#: Shingles hashed at once.
BLOCK = 4096
SIGNED = "doc_id long, version long, n long, digest binary, keys array<long>"


class MinMax:
    def __init__(self, permutations: int, rows: int):
        numbers = np.random.default_rng(20240229).integers(1, 1 << 63, 2 * permutations, dtype=np.uint64)
        self.factors = (numbers[:permutations] * np.uint64(2) + np.uint64(1))[:, None]
        self.offsets = numbers[permutations:][:, None]
        self.rows, self.bands = rows, 2 * permutations // rows

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """One key per band; band k takes every ``bands``-th signature value from k on."""
        low, high = None, None
        for start in range(0, len(shingles), BLOCK):
            values = self.factors * shingles[None, start:start + BLOCK] + self.offsets
            least, most = values.min(axis=1), values.max(axis=1)
            low = least if low is None else np.minimum(low, least)
            high = most if high is None else np.maximum(high, most)
        signature = np.concatenate([low, high])[:self.bands * self.rows].reshape(self.rows, self.bands)
        key = np.arange(self.bands, dtype=np.uint64)
        for row in signature:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
        return key.view(np.int64)


def signer(shingle: int, permutations: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = MinMax(permutations, rows)
        for batch in batches:
            values, starts = lists(batch.column("words"))
            sizes, digests, keys = [], [], []
            for row in range(batch.num_rows):
                own = shingle_set(values[starts[row]:starts[row + 1]], shingle)
                sizes.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                               if len(own) else None)
                keys.append(maker.keys(own) if len(own) else np.zeros(0, np.int64))
            offsets = np.cumsum([0] + [len(k) for k in keys]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(
                offsets, np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("version"), pa.array(sizes, pa.int64()),
                 pa.array(digests, pa.binary()), arrays], ["doc_id", "version", "n", "digest", "keys"])

    return sign


def sets(shingle: int):
    @F.arrow_udf("array<long>")
    def distinct(batch: pa.Array) -> pa.Array:
        values, starts = lists(batch)
        found = [shingle_set(values[starts[r]:starts[r + 1]], shingle).view(np.int64)
                 for r in range(len(batch))]
        offsets = np.cumsum([0] + [len(own) for own in found]).astype(np.int32)
        return pa.ListArray.from_arrays(
            offsets, np.concatenate(found) if found else np.zeros(0, np.int64))

    return distinct


def lowered(text: Column) -> Column:
    return words(F.translate(text, UPPER, LOWER))


def release(spark) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that are no longer in use."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


class Linker:
    """Finds the links between distinct shingle sets, numbered as nodes."""

    def __init__(self, nodes: DataFrame, similarity: int):
        self.similarity = similarity
        self.sizes = nodes.select("node", "n")
        bands = nodes.select("node", "n", F.explode("keys").alias("key"))
        shared = (bands.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
        self.members = written(bands.join(shared, "key"), "bands")
        self.small = written(self.pairs_within(self.members.where(F.col("k") <= SMALL)), "pairs")
        self.big = self.members.where(F.col("k") > SMALL).drop("k")

    def like(self, a: Column, b: Column) -> Column:
        """Whether sets of these sizes can be similar at all."""
        return (a * 100 >= b * self.similarity) & (b * 100 >= a * self.similarity)

    def pairs_within(self, members: DataFrame) -> DataFrame:
        """Distinct pairs (a < b) of like size in the same band."""
        left, right = members.alias("l"), members.alias("r")
        return (left.join(right, (F.col("l.key") == F.col("r.key"))
                          & (F.col("l.node") < F.col("r.node")) & self.like(F.col("l.n"), F.col("r.n")))
                .select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct())

    def needed(self) -> DataFrame:
        """The nodes whose sets are compared at some time."""
        return (self.small.select(F.explode(F.array("a", "b")).alias("node"))
                .unionByName(self.big.select("node")).distinct())

    def run(self, shingles: DataFrame) -> DataFrame:
        """(node, label) of all linked nodes; ``shingles`` holds (node, n, shingles)."""
        self.shingles = shingles
        lowest = self.big.groupBy("key").agg(F.min(F.struct("node", "n")).alias("c"))
        stars = (self.big.join(lowest, "key")
                 .where((F.col("node") != F.col("c.node")) & self.like(F.col("n"), F.col("c.n")))
                 .select(F.col("c.node").alias("a"), F.col("node").alias("b")))
        tested = written(self.small.unionByName(stars).distinct(), "pairs")
        links = self.confirmed(tested)
        labels = written(components(links), "links")
        for _ in range(ROUNDS):
            pairs = written(self.to_hubs(self.mixed(labels), links)
                            .join(tested, ["a", "b"], "left_anti"), "pairs")
            if pairs.isEmpty():
                break
            more = self.confirmed(pairs)
            labels = written(extended(labels, more), "links")
            links, tested = links.unionByName(more), tested.unionByName(pairs)
        rest = written(self.unresolved(self.mixed(labels))
                       .join(tested, ["a", "b"], "left_anti"), "pairs")
        if rest.isEmpty():
            return labels
        return written(extended(labels, self.confirmed(rest)), "links")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        own = self.shingles
        left = own.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
        right = own.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
        common = F.size(F.array_intersect("s_a", "s_b")).cast("long")
        met = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", common.alias("common"))
        return written(met.where(F.col("common") * 100 >= (
            F.col("n_a") + F.col("n_b") - F.col("common")) * self.similarity).select("a", "b"), "links")

    def mixed(self, labels: DataFrame) -> DataFrame:
        """Members of frequent bands that hold more than one component, with their labels."""
        members = (self.big.join(labels, "node", "left")
                   .withColumn("label", F.coalesce("label", "node")))
        mixed = (members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                            F.min("n").alias("least")).where("low != high"))
        return written(members.join(mixed.select("key", "least"), "key"), "bands")

    def to_hubs(self, members: DataFrame, links: DataFrame) -> DataFrame:
        """Each member with the member of its band that has most links, if of another component."""
        degree = (links.select(F.explode(F.array("a", "b")).alias("node"))
                  .groupBy("node").agg(F.count(F.lit(1)).alias("degree")))
        ranked = members.join(degree, "node", "left").withColumn(
            "rank", F.struct(F.coalesce("degree", F.lit(0)).alias("degree"),
                             (-F.col("node")).alias("order"), "label", "n"))
        hubs = ranked.groupBy("key").agg(F.max("rank").alias("hub"))
        hub = -F.col("hub.order")
        return (members.join(hubs, "key")
                .where((F.col("label") != F.col("hub.label")) & self.like(F.col("n"), F.col("hub.n")))
                .select(F.least("node", hub).alias("a"), F.greatest("node", hub).alias("b")).distinct())

    def unresolved(self, members: DataFrame) -> DataFrame:
        """Pairs of different labels that may be linked, by their rarest shingles.

        A link to a set of at least ``least`` shingles needs a certain overlap. With shingles
        in order of frequency, sets with this overlap share one of their first ones, so many
        as may be missing and one more. Sets that differ from a large group by shingles of
        their own start with these, and so meet none of its members. A shingle's most frequent
        label is left out on one side: its members are not to be compared with each other.
        """
        nodes = members.groupBy("node", "label", "n").agg(F.min("least").alias("least"))
        share = self.similarity / 100
        other = F.greatest(F.col("least"), F.ceil(F.col("n") * share - 1e-6))
        need = F.ceil((F.col("n") + other) * (share / (1 + share)) - 1e-6)
        held = (nodes.withColumn("first", F.col("n") - need + 1)
                .join(self.shingles.select("node", "shingles"), "node")
                .select("node", "label", "n", "first", F.explode("shingles").alias("shingle")))
        frequency = held.groupBy("shingle").agg(
            F.count(F.lit(1)).alias("f"), F.min("label").alias("low"), F.max("label").alias("high"))
        place = F.row_number().over(Window.partitionBy("node").orderBy("f", "shingle"))
        rare = written(held.join(frequency, "shingle").withColumn("place", place)
                       .where((F.col("place") <= F.col("first")) & (F.col("low") != F.col("high")))
                       .select("shingle", "node", "label", "n",
                               (F.col("n") - F.col("place") + 1).alias("left")), "rare")
        counted = rare.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("k"))
        main = (counted.groupBy("shingle").agg(F.max_by("label", "k").alias("main"),
                                               F.count(F.lit(1)).alias("labels")).where("labels > 1"))
        left = rare.join(main, "shingle").where("label != main").alias("l")
        right = rare.alias("r")
        # Of the shingles from their first common one on, there must be enough in both sets.
        both = (F.col("l.n") + F.col("r.n")) * self.similarity
        enough = F.least("l.left", "r.left") * (100 + self.similarity) >= both
        met = left.join(right, (F.col("l.shingle") == F.col("r.shingle"))
                        & (F.col("l.label") != F.col("r.label")) & enough)
        return met.select(F.least("l.node", "r.node").alias("a"),
                          F.greatest("l.node", "r.node").alias("b")).distinct()


def near_groups(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5,
                similarity: int = 80, permutations: int = 100, rows: int = 5) -> DataFrame:
    """One row per document: doc_id, version (hash of the text), n_shingles, component_id, kept.

    Words are separated by white space, with A-Z in lower case. A document's set is its
    distinct ``shingle``-word shingles, or the whole sequence if it has fewer words. Two sets
    are linked if they share ``similarity`` percent of their union, counted on the full sets.
    component_id is the smallest doc_id reachable over links; the document with that id is
    kept. Null texts and texts without words have no shingles, are linked with nothing and
    kept. Rows without an id are not linked: their component is null, and they are kept.
    Repeated rows get equal results. An empty table gives no rows; other columns are ignored.

    Equal sets are grouped by digest first. ``2 * permutations / rows`` bands of ``rows`` values
    miss a pair of similarity 0.8 with a probability of about one in eight million (defaults),
    more similar pairs less often.
    """
    spark = documents.sparkSession
    keyed = documents.select(F.col(doc_id).cast("long").alias("doc_id"),
                             F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text"))
    signed = written(keyed.select("doc_id", "version", hashes(lowered(F.col("text"))).alias("words"))
                     .mapInArrow(signer(shingle, permutations, rows), SIGNED), "signed")
    first = F.min(F.struct("doc_id", "version"))
    nodes = written(
        signed.where("digest is not null and doc_id is not null").groupBy("digest")
        .agg(first.alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"))
        .select(F.monotonically_increasing_id().alias("node"), "digest", "first.doc_id",
                "first.version", "n", "keys"), "nodes")
    linker = Linker(nodes, similarity)
    release(spark)
    wanted = nodes.join(linker.needed(), "node").select("node", "n", "doc_id", "version")
    shingles = written(
        keyed.join(wanted, ["doc_id", "version"]).dropDuplicates(["node"])
        .select("node", "n", sets(shingle)(hashes(lowered(F.col("text")))).alias("shingles")), "sets")
    del wanted
    release(spark)
    labels = linker.run(shingles)
    placed = nodes.select("node", "digest", "doc_id").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    lowest = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    groups = written(placed.join(lowest, "label").select("digest", "component_id"), "groups")
    release(spark)
    found = signed.drop("keys").join(groups, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).when(
        F.col("doc_id").isNotNull(), F.col("component_id"))
    return (found.withColumn("component_id", component)
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
            .select("doc_id", "version", F.col("n").alias("n_shingles"), "component_id", "kept"))


def keep_one(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``documents`` without all but one of each group of near duplicates; of repeated rows one stays.

    Rows without text or without an id stay as ``near_groups`` says.
    """
    kept = near_groups(documents, doc_id, text, **options).where("kept").select(
        F.col("doc_id").alias("_doc_id"), F.col("version").alias("_version")).distinct()
    keyed = documents.withColumn("_hash", F.xxhash64(F.col(text)))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_doc_id")) & (F.col("_hash") == F.col("_version"))
    met = keyed.join(kept, same)
    return met.dropDuplicates(["_doc_id", "_version"]).drop("_doc_id", "_version", "_hash")
