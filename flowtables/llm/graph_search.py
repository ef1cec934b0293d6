"""Nearest neighbours by cosine with robust-pruned directed graphs, one per shard.

A shard's graph is built by greedy searches, which propose neighbours for each vector, and
a pruning that drops a neighbour if another one is closer to it by a factor: edges stay
diverse. Queries run a beam search through every shard's graph; the best of all shards,
scored in double precision on the original vectors, are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from flowtables.session import written

INDEX = ("shard int, node int, entry boolean, ids array<long>, vector {vector}, "
         "neighbours array<int>, keep int")
FOUND = "query_id long, vec_id long, score double"
#: Queries or new nodes searched together.
BATCH = 256


def beam_search(vectors: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray,
                width: int, log: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest nodes met per query and their distances; -1 where there are fewer.

    All vectors have length 1; the distance is 1 - cosine. ``log`` gets (queries, nodes) of
    every step, the nodes that searches have visited.
    """
    count, empty = len(queries), np.float32(np.inf)
    nodes = np.full((count, width), -1, np.int64)
    far = np.full((count, width), empty, np.float32)
    done = np.ones((count, width), bool)
    nodes[:, 0], done[:, 0] = entry, False
    far[:, 0] = 1 - queries @ vectors[entry]
    active = np.arange(count)
    while True:
        waiting = np.where(done[active], empty, far[active])
        best = waiting.argmin(axis=1)
        left = np.isfinite(waiting[np.arange(len(active)), best])
        active, best = active[left], best[left]
        if not len(active):
            return nodes, far
        at = nodes[active, best]
        done[active, best] = True
        if log is not None:
            log.append((active, at))
        near = graph[at]
        distance = 1 - np.einsum("qrd,qd->qr", vectors[near], queries[active])
        known = (near[:, :, None] == nodes[active][:, None, :]).any(axis=2)
        distance[known | (near < 0)] = empty
        all_nodes = np.concatenate([nodes[active], near], axis=1)
        all_far = np.concatenate([far[active], distance], axis=1)
        all_done = np.concatenate([done[active], np.zeros(near.shape, bool)], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
        rows = np.arange(len(active))[:, None]
        far[active] = all_far[rows, order]
        kept = np.isfinite(far[active])
        nodes[active] = np.where(kept, all_nodes[rows, order], -1)
        done[active] = np.where(kept, all_done[rows, order], True)


def prune(vectors: np.ndarray, node: int, candidates: np.ndarray, degree: int,
          relax: float) -> np.ndarray:
    """At most ``degree`` of the candidates: the nearest one stays, those that are nearer to it, by
    the factor ``relax``, than to the node go, and so on."""
    candidates = np.unique(candidates[(candidates >= 0) & (candidates != node)])
    far = 1 - vectors[candidates] @ vectors[node]
    order = np.lexsort((candidates, far))
    candidates, far = candidates[order], far[order]
    own = vectors[candidates]
    between = 1 - own @ own.T
    alive = np.ones(len(candidates), bool)
    kept = []
    for at in range(len(candidates)):
        if alive[at]:
            kept.append(at)
            if len(kept) == degree:
                break
            alive &= relax * between[at] > far
    return candidates[kept]


def build(vectors: np.ndarray, degree: int, width: int, relax: float) -> tuple[np.ndarray, int]:
    """The neighbours per node (-1: none) and the node where searches start."""
    count = len(vectors)
    rng = np.random.default_rng(17)
    entry = int((vectors @ vectors.mean(axis=0)).argmax())
    graph = np.full((count, degree), -1, np.int64)
    if count > 1:
        start = min(degree // 2, count - 1)
        graph[:, :start] = (np.arange(count)[:, None] + rng.integers(1, count, (count, start))) % count
    order = rng.permutation(count)
    for factor in (1.0, relax):
        for at in range(0, count, BATCH):
            batch = order[at:at + BATCH]
            log: list = []
            nodes, _ = beam_search(vectors, graph, entry, vectors[batch], width, log)
            proposed = [[row] for row in nodes]
            for searched, visited in log:
                for which, node in zip(searched, visited):
                    proposed[which].append(node)
            back: dict[int, list[int]] = {}
            for row, node in enumerate(batch):
                near = np.concatenate([proposed[row][0], np.array(proposed[row][1:], np.int64),
                                       graph[node]])
                chosen = prune(vectors, node, near, degree, factor)
                graph[node] = -1
                graph[node, :len(chosen)] = chosen
                for other in chosen:
                    back.setdefault(int(other), []).append(int(node))
            for node, incoming in back.items():
                own = graph[node][graph[node] >= 0]
                new = np.setdiff1d(np.array(incoming, np.int64), own)
                if len(own) + len(new) > degree:
                    own = prune(vectors, node, np.concatenate([own, new]), degree, factor)
                else:
                    own = np.concatenate([own, new])
                graph[node] = -1
                graph[node, :len(own)] = own
    return graph, entry


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))).astype(np.float32)


def matrix(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    joined = column.combine_chunks()
    return np.asarray(joined.flatten(), dtype=np.float64).reshape(-1, dimension)


def component(rows: DataFrame, vector: str) -> str:
    """The type in which vectors are kept: their own if it is float, double for all others."""
    own = rows.select(F.col(vector)[0]).schema[0].dataType
    return "array<float>" if isinstance(own, FloatType) else "array<double>"


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times the power of two that brings their largest component below 1, which changes
    no cosine; no square overflows or vanishes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def builder(degree: int, width: int, relax: float, keep: int):
    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("digest")
        vectors = matrix(table.column("vector"), len(table.column("vector")[0]))
        graph, entry = build(unit(vectors), degree, width, relax)
        count = len(vectors)
        return pa.table({
            "shard": table.column("shard"), "node": pa.array(np.arange(count), pa.int32()),
            "entry": pa.array(np.arange(count) == entry), "ids": table.column("ids"),
            "vector": table.column("vector"),
            "neighbours": pa.array([row[row >= 0].tolist() for row in graph], pa.list_(pa.int32())),
            "keep": pa.array([keep] * count, pa.int32())})

    return make


class Shard:
    """The graph of one shard, ready to be searched."""

    def __init__(self, index: pa.Table):
        index = index.sort_by("node")
        self.vectors = scaled(matrix(index.column("vector"), len(index.column("vector")[0])))
        self.near = unit(self.vectors)
        self.sizes = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        lists = index.column("neighbours").to_pylist()
        self.graph = np.full((len(lists), max(1, max(map(len, lists)))), -1, np.int64)
        for at, own in enumerate(lists):
            self.graph[at, :len(own)] = own
        self.entry = index.column("entry").to_pylist().index(True)
        self.ids = index.column("ids").to_pylist()

    def search(self, queries: pa.Table, k: int, width: int) -> Iterator[tuple[int, int, float]]:
        """(query_id, vec_id, score) of each query's best ``k``."""
        asked = scaled(matrix(queries.column("vector"), self.vectors.shape[1]))
        normal, names = unit(asked), queries.column("query_id").to_pylist()
        for start in range(0, len(asked), BATCH):
            nodes, _ = beam_search(self.near, self.graph, self.entry, normal[start:start + BATCH],
                                   max(width, k + 1))
            for row, own in enumerate(nodes, start):
                own = own[own >= 0]
                products = (self.vectors[own] * asked[row]).sum(axis=1)
                scores = products / (self.sizes[own] * np.sqrt((asked[row] * asked[row]).sum()))
                pairs = [(-score, vec_id) for node, score in zip(own, scores.tolist())
                         for vec_id in self.ids[node] if vec_id != names[row]]
                for score, vec_id in sorted(pairs)[:k]:
                    yield names[row], vec_id, -score


def searcher(k: int, width: int):
    """Reads shards one after the other, each with its index rows before its queries; keeps one
    shard's graph and a batch of queries at a time."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[pa.Table] = []
        number, shard = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            places = table.column("shard").to_numpy()
            ends = np.append(np.flatnonzero(np.diff(places)) + 1, len(places))
            for start, end in zip(np.append(0, ends[:-1]), ends):
                part = table.slice(start, end - start)
                if places[start] != number:
                    number, shard, gathered = places[start], None, []
                index = part.filter(pc.invert(part.column("is_query")))
                if index.num_rows:
                    gathered.append(index)
                queries = part.filter(part.column("is_query"))
                if queries.num_rows and gathered:
                    shard, gathered = Shard(pa.concat_tables(gathered)), []
                if queries.num_rows and shard:
                    found = list(shard.search(queries, k, width))
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(values, kind) for values, kind in zip(
                                zip(*found), (pa.int64(), pa.int64(), pa.float64()))],
                            ["query_id", "vec_id", "score"])

    return search


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def index_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", keep: int = 6,
                  shard_rows: int = 4096, degree: int = 32, width: int = 48,
                  relax: float = 1.2) -> DataFrame:
    """The graphs of all usable vectors, one row per distinct vector, written to the shared folder.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without
    an id take no part. Equal vectors are one node with their ``keep`` smallest ids, which is
    all that a search for ``keep - 1`` neighbours can return of them, and a search for more is
    an error; the limit is applied before the shuffle, so a very frequent vector is no hot key.
    Vectors are kept in their own precision. Nodes are dealt by hash to
    shards of about ``shard_rows``; vectors of different lengths are in different shards.
    """
    own, kind = F.col(vector), component(rows, vector)
    digest = F.sha2(F.array_join(own.cast("array<string>"), ","), 256)
    valid = rows.where(usable(own) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), own.cast(kind).alias("vector"),
        digest.alias("digest")).dropDuplicates(["digest", "vec_id"])
    order = Window.partitionBy("digest").orderBy("vec_id")
    first = valid.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    nodes = written(first.groupBy("digest").agg(
        F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("vector").alias("vector")), "vectors")
    shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.withColumn("shard", (F.pmod(F.xxhash64("digest"), F.lit(shards))
                                       + F.size("vector") * shards).cast("int"))
    graphs = dealt.groupBy("shard").applyInArrow(builder(degree, width, relax, keep), INDEX.format(vector=kind))
    return written(graphs, "graphs")


def nearest(index: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
            k: int = 5, width: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``index`` found per query.

    Nearest first, ties to the smaller vec_id; rows with the query's own id do not count. A
    query that is not usable has no rows; of queries that repeat an id one is asked. Queries
    go to every shard of their length, whose task reads its graph once and then the queries as
    a stream; each returns its best ``k``. An index that keeps too few ids of equal vectors
    for ``k`` is an error.
    """
    kept = index.select("keep").first()
    if kept is not None and k > kept[0] - 1:
        raise ValueError(f"the index keeps {kept[0]} ids of equal vectors; for {k} neighbours build it with keep={k + 1}")
    own, kind = F.col(vector), component(queries, vector)
    if kind != component(index, "vector"):
        kind = "array<double>"
    asked = (queries.where(usable(own) & F.col(vec_id).isNotNull())
             .groupBy(F.col(vec_id).cast("long").alias("query_id"))
             .agg(F.min(own.cast(component(queries, vector))).alias("vector"))
             .withColumn("vector", F.col("vector").cast(kind))
             .withColumn("dimension", F.size("vector")))
    shards = index.groupBy("shard").agg(F.max(F.size("vector")).alias("dimension"))
    sent = asked.join(shards, "dimension").drop("dimension")
    graphs = index.drop("keep").withColumn("vector", F.col("vector").cast(kind))
    both = (graphs.withColumn("is_query", F.lit(False))
            .unionByName(sent.withColumn("is_query", F.lit(True)), allowMissingColumns=True))
    found = (both.repartition(max(1, shards.count()), "shard").sortWithinPartitions("shard", "is_query")
             .mapInArrow(searcher(k, width), FOUND))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
