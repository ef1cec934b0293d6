"""Tables as the latest row per key, their diff, and dependency levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtables.functions.expressions import fingerprint
from flowtables.session import written


def latest_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The newest row of every key; map-side combined, so a hot key stays cheap.

    A row whose order is null is older than any other one of its key.
    """
    values = [name for name in df.columns if name not in keys]
    row = F.max_by(F.struct(*values), F.struct(order.isNotNull().alias("known"), order.alias("at")))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*")


def rekeyed(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Add the output ``partition`` of each row's ``key`` and lay rows out by it.

    The rebalance hint writes whole partitions together but lets AQE split one
    that holds a hot key over several tasks.
    """
    target = F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")
    return df.withColumn("partition", target).hint("rebalance", "partition")


def write_partitions(df: DataFrame, key: str, partitions: int, folder: str) -> None:
    """Write rows as ``partitions`` partition folders chosen by ``key``."""
    rekeyed(df, key, partitions).write.partitionBy("partition").parquet(folder)


def snapshot_diff(desired: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Action per key that turns ``observed`` into ``desired``: create, replace, keep, drop.

    Only keys and row fingerprints are shuffled. Keys are unique on either side.
    """
    values = [name for name in desired.columns if name not in keys]
    both = _marked(desired, keys, values, "desired").join(
        _marked(observed, keys, values, "observed"), "_group", "full")
    return both.select("_group.*", _action(F.col("desired"), F.col("observed")))


def _marked(df: DataFrame, keys: list[str], values: list[str], name: str) -> DataFrame:
    return df.select(F.struct(*keys).alias("_group"),
                     fingerprint(*[F.col(v) for v in values]).alias(name))


def _action(desired: Column, observed: Column) -> Column:
    return (F.when(observed.isNull(), "create").when(desired.isNull(), "drop")
            .when(desired == observed, "keep").otherwise("replace").alias("action"))


def snapshot_diff_sparse(desired: DataFrame, observed: DataFrame, key: str,
                         shifts: tuple[int, ...] = (8, 4)) -> DataFrame:
    """:func:`snapshot_diff` for tables that differ in few places, on one key of whole numbers.

    Ranges of ``2 ** shift`` keys get an order-free digest of their rows on either side, first
    wide ranges, then narrow ones within those that differ. Only rows of narrow ranges that
    differ are compared one by one; all others are kept without being shuffled. Where the tables
    are laid out by key, a range's rows are in a task or two and its digest is made before the
    shuffle. Each level reads both tables again, so many scattered changes cost more this way.

    A key that occurs more than once is compared as the bag of its rows where its range differs,
    and is kept once per row where it does not. A null key is a key like others.
    """
    values = [name for name in desired.columns if name != key]
    suspect = None
    for shift in shifts:
        sides = [_digests(_within(df, key, suspect), key, values, shift) for df in (desired, observed)]
        left, right = (side.select("range", F.struct("rows", "first", "second").alias(name))
                       for side, name in zip(sides, ("desired", "observed")))
        differ = left.join(right, "range", "full").where(~F.col("desired").eqNullSafe(F.col("observed")))
        suspect = (shift, written(differ.select("range"), "differing"))

    def bags(df, name):
        return (_marked(_within(df, key, suspect), [key], values, name).groupBy("_group")
                .agg(F.array_sort(F.collect_list(name)).alias(name)))

    both = bags(desired, "desired").join(bags(observed, "observed"), "_group", "full")
    compared = both.select("_group.*", _action(F.col("desired"), F.col("observed")))
    kept = _within(desired, key, suspect, "left_anti").select(key)
    return compared.unionByName(kept.withColumn("action", F.lit("keep")))


def _range(key: Column, shift: int) -> Column:
    """The number of a key's range, in a struct so that null keys are a range that can be joined."""
    return F.struct(F.shiftright(key.cast("bigint"), shift).alias("number"))


def _within(df: DataFrame, key: str, suspect: tuple | None, how: str = "left_semi") -> DataFrame:
    if suspect is None:
        return df
    shift, ranges = suspect
    return df.withColumn("_range", _range(F.col(key), shift)).join(
        ranges.withColumnRenamed("range", "_range"), "_range", how).drop("_range")


def _digests(df: DataFrame, key: str, values: list[str], shift: int) -> DataFrame:
    """Number of rows of each range and two sums of hashes of their fingerprints.

    Sums tell repeated rows apart, as exclusive-or would not; 40 bits leave room for 8 million
    rows of a range.
    """
    row = fingerprint(*[F.col(v) for v in (key, *values)])

    def digest(*seed: Column) -> Column:
        return F.sum(F.pmod(F.xxhash64(*seed, "row"), F.lit(1 << 40)))

    return df.select(_range(F.col(key), shift).alias("range"), row.alias("row")).groupBy("range").agg(
        F.count(F.lit(1)).alias("rows"), digest().alias("first"), digest(F.lit(1)).alias("second"))


def dependency_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Level of every node: 0 without dependencies, else one above its highest one.

    ``nodes(node)``, ``edges(node, needs)``; edges of or to unknown nodes do not count.
    Nodes on or behind a cycle get level null.

    A round first contracts: nodes with a single open need form trees, and pointer doubling
    takes each of them to the first node above that is not one of them, in the logarithm of
    the tree's depth. What the others need is moved up in the same way, and equal edges
    become one, the longest. Then nodes without open needs are released. Chains, trees and
    whatever falls apart into them thus take few rounds however deep they are; a lattice, in
    which every node keeps several needs, takes one round per level. Each round writes the
    edges and floors still open, so the plan does not grow with the rounds.
    """
    known = written(nodes.select("node").where(F.col("node").isNotNull()).distinct(), "nodes")
    needs = written(edges.select("node", "needs").distinct()
                    .join(known, "node", "left_semi")
                    .join(known.select(F.col("node").alias("needs")), "needs", "left_semi")
                    .select("node", "needs", F.lit(1).cast("bigint").alias("length")), "edges")
    # The level that the needs released so far ask for at least.
    floors = written(known.select("node", F.lit(0).cast("bigint").alias("floor")), "floors")
    trees, found = [], []
    while True:
        open_needs = needs.groupBy("node").agg(F.count(F.lit(1)).alias("open"))
        state = written(floors.join(open_needs, "node", "left"), "open")
        free = state.where("open IS NULL").select("node", F.col("floor").alias("level"))
        single, several = state.where("open = 1"), state.where("open > 1").select("node", "floor")
        if not single.isEmpty():
            links = single.join(needs, "node").select("node", "floor", F.col("needs").alias("to"), "length")
            tree = _contracted(links)
            trees.append(tree)
            up = tree.select(F.col("node").alias("needs"), "to", F.col("floor").alias("through"),
                             F.col("length").alias("further"))
            moved = written(several.select("node").join(needs, "node").join(up, "needs", "left"), "moved")
            needs = moved.groupBy("node", F.when(F.col("to").isNull(), F.col("needs"))
                                  .otherwise(F.col("to")).alias("needs")).agg(
                F.max(F.col("length") + F.coalesce("further", F.lit(0))).alias("length"))
            asked = moved.groupBy("node").agg(F.max(F.col("through") + F.col("length")).alias("asked"))
            needs, floors = written(needs, "edges"), _raised(several, asked)
        else:
            floors = several
        found.append(free)
        released = needs.join(free.select(F.col("node").alias("needs"), "level"), "needs", "left")
        released = written(released, "released")
        asked = released.where("level IS NOT NULL").groupBy("node").agg(
            F.max(F.col("level") + F.col("length")).alias("asked"))
        floors = written(_raised(floors, asked), "floors")
        needs = released.where("level IS NULL").select("node", "needs", "length")
        if free.isEmpty() and single.isEmpty() or floors.isEmpty():
            break
    levels = written(_union(found), "levels")
    for tree in reversed(trees):  # a tree hangs on nodes of later rounds, or on its own round's
        top = levels.select(F.col("node").alias("to"), "level")
        levels = written(levels.unionByName(tree.join(top, "to").select(
            "node", F.greatest("floor", F.col("level") + F.col("length")).alias("level"))), "levels")
    return known.join(levels, "node", "left").select("node", F.col("level").cast("int").alias("level"))


def _union(frames: list[DataFrame]) -> DataFrame:
    first, *others = frames
    for other in others:
        first = first.unionByName(other)
    return first


def _raised(floors: DataFrame, asked: DataFrame) -> DataFrame:
    """``floors`` (node, floor), at least what is ``asked`` (node, asked)."""
    return floors.join(asked, "node", "left").select("node", F.greatest("floor", "asked").alias("floor"))


def _contracted(links: DataFrame) -> DataFrame:
    """Links of nodes with a single need, each led to the first node above without a link.

    ``links(node, floor, to, length)``: a node's level is the greater of ``floor`` and the
    level of ``to`` plus ``length``. Each round follows two links at once. Links that never
    come to an end are on or behind a cycle; they stay as they are, and so their nodes get no
    level: the node at their other end has none either.
    """
    links = written(links, "links")
    rounds = links.count().bit_length() + 1
    for _ in range(rounds):
        onward = links.select(F.col("node").alias("to"), F.col("floor").alias("_floor"),
                              F.col("to").alias("_to"), F.col("length").alias("_length"))
        joined = links.join(onward, "to", "left")
        goes_on = F.col("_to").isNotNull()
        links = written(joined.select(
            "node",
            F.when(goes_on, F.greatest("floor", F.col("_floor") + F.col("length")))
            .otherwise(F.col("floor")).alias("floor"),
            F.when(goes_on, F.col("_to")).otherwise(F.col("to")).alias("to"),
            F.when(goes_on, F.col("length") + F.col("_length")).otherwise(F.col("length")).alias("length"),
            goes_on.alias("_moved")), "links")
        moved, links = links.where("_moved").isEmpty(), links.drop("_moved")
        if moved:
            break
    return links
