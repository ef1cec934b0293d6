"""The prefix trie of conversations by truncation peeling.

A conversation is a path of turn digests. Paths are sorted and cut into blocks. A block is
peeled from its greatest depth down: what survives from the depth above is merged with the
conversations that end at this depth, neighbours of equal prefix are regrouped, and the last
turn is stripped. Nodes are found and summed in that one pass. A node that might go on in
the block before or after stays open; a block leaves at most two paths of open nodes, and
those paths are peeled again, together, until one block holds all.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables.session import written

#: Bytes of a turn's digest.
WIDTH = 16
#: Nodes of paths that a block holds; it takes ``LEAST_PATHS`` paths however long they are.
BLOCK_NODES = 50_000
LEAST_PATHS = 64
#: Conversation ids are gathered in ranges of two to this power.
ID_RANGE = 10
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE_FIELDS = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
               ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
               ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("key", pa.binary()),
               ("parent_key", pa.binary())]
OPEN = pa.struct([("depth", pa.int64()), ("n", pa.int64()), ("conv", pa.int64()),
                  ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()),
                  ("ends", pa.string())])
FIELDS = [*NODE_FIELDS, ("path", pa.binary()), ("sizes", pa.list_(pa.int64())),
          ("open", pa.list_(OPEN))]
DDL = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
       "n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary, "
       "path binary, sizes array<long>, open array<struct<depth: long, n: long, conv: long, "
       "children: long, leaves: long, saved: long, ends: string>>")


class Path:
    """A path of turns, with what is known of its nodes by depth.

    ``known`` holds, for some depths, (depth, n, conv, children, leaves, saved, ends): the
    conversations counted so far at that node, the smallest of them, its closed children with
    their leaves and savings, and the digest of the conversations that end there, if any do.
    """

    __slots__ = ("turns", "sizes", "known")

    def __init__(self, turns: bytes, sizes: list[int], known: list[tuple]):
        self.turns, self.sizes, self.known = turns, sizes, known


class Node:
    """Adjacent paths of a block that share their first turns, and what is known beneath."""

    __slots__ = ("first", "last", "n", "conv", "children", "leaves", "saved", "ends", "below")

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last
        self.n = self.children = self.leaves = self.saved = 0
        self.conv = self.ends = None
        self.below: list[Node] = []

    def add(self, n, conv, children, leaves, saved, ends) -> None:
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv = conv
        if ends is not None:
            self.ends = ends


def shared_turns(left: bytes, right: bytes) -> int:
    """Number of first turns that two paths have in common."""
    size = min(len(left), len(right))
    if left[:size] == right[:size]:
        return size // WIDTH
    if size <= 32 * WIDTH:
        at = 0
        while left[at:at + WIDTH] == right[at:at + WIDTH]:
            at += WIDTH
        return at // WIDTH
    differ = np.frombuffer(left, np.uint8, size) != np.frombuffer(right, np.uint8, size)
    return int(differ.argmax()) // WIDTH


def prefix_keys(turns: bytes) -> list[bytes]:
    """A digest of each prefix of a path, from the root to the whole path."""
    state, found = hashlib.md5(), []
    found.append(state.digest())
    for at in range(0, len(turns), WIDTH):
        state.update(turns[at:at + WIDTH])
        found.append(state.digest())
    return found


def peel(paths: list[Path], whole: bool, keyed: bool) -> tuple[list[tuple], list[Path]]:
    """The nodes of sorted, different paths, as rows of ``NODE_FIELDS``, and what stays open.

    ``whole``: there are no other paths, so nothing stays open. ``keyed``: give each node its
    key, for the children that were closed before it. A child of an open node carries that
    node's key in the place of its smallest conversation.
    """
    last = len(paths) - 1
    shared = [0] + [shared_turns(a.turns, b.turns) for a, b in zip(paths, paths[1:])]
    by_depth: dict[int, list[tuple]] = defaultdict(list)
    for at, path in enumerate(paths):
        for depth, *known in path.known:
            by_depth[depth].append((at, known))
    edge_keys = {} if whole else {at: prefix_keys(paths[at].turns) for at in {0, last}}
    open_left: list[tuple] = []
    open_right: list[tuple] = []
    rows: list[tuple] = []

    def is_open(node: Node) -> bool:
        return not whole and (node.first == 0 or node.last == last)

    def key_of(node: Node, depth: int) -> bytes:
        return edge_keys[0 if node.first == 0 else last][depth]

    def emit(child: Node, depth: int, parent: Node | None) -> None:
        """Write a closed node of ``depth``, now that its parent is known."""
        hidden = parent is not None and is_open(parent)
        rows.append((child.conv, depth, None if parent is None or hidden else parent.conv, child.n,
                     child.children, child.leaves, child.saved, child.ends or NO_ENDS,
                     hashlib.md5(paths[child.first].turns[:depth * WIDTH]).digest() if keyed else None,
                     key_of(parent, depth - 1) if hidden else None))

    survivors: list[Node] = []
    for depth in range(max(len(path.turns) for path in paths) // WIDTH, -1, -1):
        items = [(node.first, 0, node) for node in survivors]
        items += [(at, 1, known) for at, known in by_depth.pop(depth, ())]
        items.sort(key=lambda item: item[:2])
        nodes: list[Node] = []
        for first, kind, item in items:
            end = item.last if kind == 0 else first
            node = nodes[-1] if nodes else None
            if node is None or not (first <= node.last
                                    or first == node.last + 1 and shared[first] >= depth):
                node = Node(first, end)
                nodes.append(node)
            node.last = max(node.last, end)
            if kind:
                node.add(*item)
            elif not is_open(item):
                node.add(item.n, item.conv, 1, item.leaves, item.saved, None)
                node.below.append(item)
        for node in nodes:
            for child in node.below:
                emit(child, depth + 1, node)
            node.below = []
            if is_open(node):
                known = (depth, node.n, node.conv, node.children, node.leaves, node.saved, node.ends)
                (open_left if node.first == 0 else open_right).append(known)
            else:
                node.leaves = node.leaves or 1
                if depth:
                    node.saved += (node.n - 1) * paths[node.first].sizes[depth - 1]
        survivors = nodes
    for node in survivors:
        if not is_open(node):
            emit(node, 0, None)
    edges = [] if whole else [Path(paths[0].turns, paths[0].sizes, open_left)]
    if open_right:
        edges.append(Path(paths[last].turns, paths[last].sizes, open_right))
    return rows, edges


def batch_of(rows: list[tuple], edges: list[Path]) -> pa.RecordBatch:
    names = [field.name for field in OPEN]
    columns = [list(column) + [None] * len(edges) for column in zip(*rows)] or [
        [None] * len(edges) for _ in NODE_FIELDS]
    none = [None] * len(rows)
    columns += [none + [edge.turns for edge in edges], none + [edge.sizes for edge in edges],
                none + [[dict(zip(names, known)) for known in edge.known] for edge in edges]]
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, (_, kind) in zip(columns, FIELDS)],
        [name for name, _ in FIELDS])


def ended_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[Path]:
    """Paths of conversations that end there: rows of one path follow each other by id range."""
    turns, sizes, n, conv, ids = None, [], 0, None, hashlib.sha256()

    def done() -> Path:
        depth = len(turns) // WIDTH
        return Path(turns, sizes, [(depth, n, conv, 0, 0, 0, ids.hexdigest())])

    for batch in batches:
        for row in zip(*(batch.column(name).to_pylist() for name in ("path", "sizes", "n", "conv", "ids"))):
            if row[0] == turns:
                n += row[2]
                ids.update(b"," + row[4].encode())
                continue
            if turns is not None:
                yield done()
            turns, sizes, n, conv, ids = *row[:4], hashlib.sha256(row[4].encode())
    if turns is not None:
        yield done()


def open_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[Path]:
    """Paths that blocks have left open; the two of neighbouring blocks may be one path."""
    names = [field.name for field in OPEN]
    path = None
    for batch in batches:
        for turns, sizes, known in zip(*(batch.column(name).to_pylist()
                                         for name in ("path", "sizes", "open"))):
            found = [tuple(entry[name] for name in names) for entry in known]
            if path is not None and path.turns == turns:
                path.known += found
                continue
            if path is not None:
                yield path
            path = Path(turns, sizes, found)
    if path is not None:
        yield path


def peeled(paths: DataFrame, first: bool, whole: bool) -> DataFrame:
    """One round: closed nodes and open paths of all blocks, as one table."""
    read = ended_paths if first else open_paths

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Path] = []
        nodes = 0
        for path in read(batches):
            if not whole and nodes >= BLOCK_NODES and len(held) >= LEAST_PATHS:
                yield batch_of(*peel(held, whole, not first))
                held, nodes = [], 0
            held.append(path)
            nodes += len(path.turns) // WIDTH + 1
        if held:
            yield batch_of(*peel(held, whole, not first))

    order = ["path", "ids_from"] if first else ["path"]
    dealt = paths.coalesce(1) if whole else paths.repartitionByRange("path")
    return written(dealt.sortWithinPartitions(*order).mapInArrow(blocks, DDL), "trie-nodes")


def rebuilt(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
            role: str = "role", text: str = "text", group: int = 5, modulus: int = 9) -> DataFrame:
    """Every conversation with its own first turns replaced by those of another one.

    Gives conv_id and ``turns``, an array of (digest, bytes) in order: the first ``h`` turns of
    conversation ``conv_id - conv_id % group``, then the own turns after the first ``h``, where
    ``h`` is crc32 of the id's text modulo ``modulus``. Turns are ordered by number, null first,
    and equal numbers by the MD5 of role and text. Null roles and texts are empty. Rows without
    an id belong to no conversation. Texts are hashed where they are read; what a conversation
    brings into a task is 60 bytes a turn.
    """
    role_text = [F.coalesce(F.col(name), F.lit("")) for name in (role, text)]
    digest = F.md5(F.concat(F.length(role_text[0]).cast("string"), F.lit(":"), *role_text))
    own = (conversations.where(F.col(conv_id).isNotNull())
           .select(F.col(conv_id).cast("long").alias("conv_id"),
                   F.struct(F.col(turn).alias("turn"), digest.alias("digest"),
                            F.octet_length(role_text[1]).cast("long").alias("bytes")).alias("turn"))
           .groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("own")))
    own = written(own.select("conv_id", F.transform(
        "own", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("own")),
        "trie-turns")
    heads = own.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("_from"), F.slice("own", 1, modulus - 1).alias("_head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("int")
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("_taken")), F.slice("own", 1, 0))
    rest = F.slice("own", F.col("_taken") + 1, F.greatest(F.size("own") - F.col("_taken"), F.lit(0)))
    return (own.withColumns({"_from": F.col("conv_id") - F.col("conv_id") % group, "_taken": taken})
            .join(heads, "_from", "left").select("conv_id", F.concat(head, rest).alias("turns")))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations in ``conversations`` (conv_id, turns).

    A node is the conversations (members) that begin with the same ``depth`` turns; the root has
    depth 0. Columns: conv_id (smallest member), depth, parent_conv_id, n_convs (members),
    n_children, n_leaves (childless nodes in the subtree), saved_tokens (over the subtree, members
    less one times the bytes of the last turn) and ends_sha256 (the members that have no more
    turns, ascending and joined by commas).

    Equal conversations become one path, combined before the shuffle, so a conversation that is
    repeated any number of times is one path and its ids; paths are dealt by ranges, so a common
    first turn is spread over many tasks. Ids of a path are hashed in order as a stream. Memory
    per task: a block of ``BLOCK_NODES`` nodes, and at least ``LEAST_PATHS`` paths. Each round
    leaves at most two paths of a block.

    A conversation without turns is a member of the root. No conversations give no nodes.
    """
    turns = F.col("turns")
    paths = conversations.select(
        "conv_id", F.unhex(F.array_join(F.transform(turns, lambda t: t["digest"]), "")).alias("path"),
        F.transform(turns, lambda t: t["bytes"]).alias("sizes"),
        F.shiftright("conv_id", ID_RANGE).alias("ids_from"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")),
                                   lambda c: c.cast("string")), ",")
    paths = written(paths.groupBy("path", "ids_from").agg(
        F.any_value("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"),
        F.min("conv_id").alias("conv"), ids.alias("ids")), "trie-paths")
    closed, first = [], True
    while True:
        nodes, count = paths.agg(F.sum(F.size("sizes") + 1), F.count(F.lit(1))).first()
        whole = count <= LEAST_PATHS or nodes <= BLOCK_NODES
        found = peeled(paths, first, whole)
        closed.append(found.where(F.col("path").isNull()))
        if whole:
            break
        paths, first = found.where(F.col("path").isNotNull()).select("path", "sizes", "open"), False
    every = closed[0]
    for nodes in closed[1:]:
        every = every.unionByName(nodes)
    wanted = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
              "saved_tokens", "ends_sha256"]
    if len(closed) == 1:
        return every.select(*wanted)
    known = every.where(F.col("key").isNotNull()).select(
        F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    late = every.where(F.col("parent_key").isNotNull()).join(known, "parent_key").withColumn(
        "parent_conv_id", F.col("_parent"))
    return every.where(F.col("parent_key").isNull()).select(*wanted).unionByName(late.select(*wanted))


#: The remainder of a byte, bit by bit, with the reversed polynomial of CRC-32.
CRC32_SQL = """xor(4294967295, list_reduce(
         list_prepend(4294967295, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),
         lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
           lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST,
                       md5(length(role)::VARCHAR || ':' || role || text)) AS turns
  FROM t GROUP BY conv_id),
h AS (SELECT *, ({CRC32_SQL.format(text="conv_id::VARCHAR")} % 9)::INT AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(p.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM h c LEFT JOIN own p ON p.conv_id = c.conv_id - c.conv_id % 5),
members AS (
  SELECT conv_id, d AS depth, turns[1:d] AS prefix, len(turns) = d AS ends,
         CASE WHEN d > 0 THEN strlen(turns[d].t) ELSE 0 END AS size
  FROM (SELECT conv_id, turns, unnest(generate_series(0, len(turns))) AS d FROM rebuilt)),
nodes AS (
  SELECT min(conv_id) AS conv_id, depth, prefix, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), ''))
           AS ends_sha256
  FROM members GROUP BY depth, prefix),
tops AS (
  SELECT n.conv_id, n.depth, m.depth AS above, p.conv_id AS top, (n.n_convs - 1) * n.size AS saved
  FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth
  JOIN nodes p ON p.depth = m.depth AND p.prefix = m.prefix),
children AS (SELECT top, above, count(*) AS n_children FROM tops WHERE depth = above + 1 GROUP BY ALL),
sums AS (
  SELECT t.top, t.above, count(*) FILTER (WHERE c.n_children IS NULL) AS n_leaves, sum(saved) AS saved
  FROM tops t LEFT JOIN children c ON c.top = t.conv_id AND c.above = t.depth GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.top AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       coalesce(c.n_children, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.top = n.conv_id AND s.above = n.depth
LEFT JOIN children c ON c.top = n.conv_id AND c.above = n.depth
LEFT JOIN tops u ON u.conv_id = n.conv_id AND u.depth = n.depth AND u.above = n.depth - 1
"""
