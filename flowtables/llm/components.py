"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables.session import written


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The (node, label) of ``labels``, as ``components`` gives them, after more ``links`` are added.

    Only the labels at the links' ends are joined up, however large their components are.
    """
    of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("l_a"))
    of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("l_b"))
    ends = links.join(of_a, "a", "left").join(of_b, "b", "left").select(
        F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))
    moved = written(components(ends), "links")
    onward = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    known = labels.join(onward, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return known.unionByName(moved.join(labels.select("node"), "node", "left_anti"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b); the label is the smallest node reachable.

    Large and small stars by turns: each step hangs a node's neighbours on the smallest of
    them, in a number of rounds that grows with the logarithm of the graph. The edges of a
    round are a written table; a node with very many links is an ordinary skewed join key.
    """
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("u"),
                                                 F.least("a", "b").alias("v")).distinct(), "links")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = (both.join(lowest, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("low").alias("v")).distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lowest, "u")
        edges = written(small.where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
                        .unionByName(lowest.select("u", F.col("low").alias("v"))).distinct(), "links")
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
