"""Mixing sources to target weights by the cube method.

Each document is to be taken ``target / source size`` times. The whole part of that number is
certain; the rest is an inclusion probability. The flight phase moves the probabilities of a
few documents at a time along a direction that keeps both the expected words and the expected
number of documents, until one of them is 0 or 1. A block of documents ends with at most two
that are still open; those of many blocks fly again, and the last two of a source are landed.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtables.llm.shingles import words
from flowtables.session import written

#: Probabilities this close to 0 or 1 are settled.
SETTLED = 1e-9
#: Rows that one array of an exploded repeat holds at most.
REPEATS = 100_000


def step(chances: list[float], window: list[int], along: list[float], draw: float) -> None:
    """Move the chances of ``window`` along a direction or against it until one is 0 or 1.

    The two lengths are weighed so that no chance changes in expectation.
    """
    up = min((1 - chances[at]) / u if u > 0 else chances[at] / -u
             for at, u in zip(window, along) if u)
    down = min(chances[at] / u if u > 0 else (1 - chances[at]) / -u
               for at, u in zip(window, along) if u)
    length = up if draw * (up + down) < down else -down
    for at, u in zip(window, along):
        moved = chances[at] + length * u
        chances[at] = 0.0 if moved < SETTLED else 1.0 if moved > 1 - SETTLED else moved


def flight(chances: list[float], sizes: list[float], draw: Callable[[], float]) -> list[int]:
    """Settle all chances but at most two, which are returned; sums of chances and of
    chances times sizes stay."""
    window: list[int] = []
    for at in range(len(chances)):
        window.append(at)
        while len(window) > 1:
            equal = [(a, b) for n, a in enumerate(window) for b in window[n + 1:]
                     if sizes[a] == sizes[b]]
            if equal:  # two of one size exchange chances
                step(chances, list(equal[0]), [1.0, -1.0], draw())
            elif len(window) == 3:
                a, b, c = (sizes[i] for i in window)
                scale = max(a, b, c) - min(a, b, c)
                step(chances, window, [(b - c) / scale, (c - a) / scale, (a - b) / scale], draw())
            else:
                break
            window = [i for i in window if 0 < chances[i] < 1]
        window = [i for i in window if 0 < chances[i] < 1]
    return window


def land(chances: list[float], left: list[int], draw: float) -> None:
    """Settle the last chances with one draw.

    Each keeps its chance. Of two, as seldom as possible both or none is taken: sizes are not
    negative, so this is the landing of least expected squared error in words and documents.
    """
    reached = 0.0
    for at in left:
        start, reached = reached, reached + chances[at]
        chances[at] = float(start <= draw < reached or draw < reached - 1)


def settled(seed: str) -> Callable[[tuple, pa.Table], pa.Table]:
    """A block's documents with their chances after the flight, landed if it is the last block.

    Long documents fly with short ones, from both ends of the block, so that a long one is
    settled while there are others to make up for it. The order and the draws depend on the
    rows and the seed alone.
    """
    def block(key: tuple, rows: pa.Table) -> pa.Table:
        ids = rows["doc_id"].cast(pa.string()).fill_null("").to_numpy(zero_copy_only=False)
        falling = np.lexsort((ids, rows["digest"].to_numpy(), -rows["size"].to_numpy()))
        order = np.empty_like(falling)
        order[0::2] = falling[:(len(falling) + 1) // 2]
        order[1::2] = falling[::-1][:len(falling) // 2]
        rows = rows.take(pa.array(order))
        chances = rows["chance"].to_pylist()
        draws = random.Random(":".join([seed, *(str(part.as_py()) for part in key)]))
        left = flight(chances, rows["size"].to_pylist(), draws.random)
        if rows["blocks"][0].as_py() == 1:
            land(chances, left, draws.random())
        at = rows.schema.get_field_index("chance")
        return rows.set_column(at, "chance", pa.array(chances, pa.float64()))
    return block


def ranked(sources: DataFrame) -> DataFrame:
    """Sources with ``number``, their place by code point from 0, a null source last.

    Sources are dealt by ranges and numbered from one count per range, not in one task.
    """
    order = F.col("source").asc_nulls_last()
    dealt = written(sources.repartitionByRange(order).withColumn("_range", F.spark_partition_id()),
                    "mix-ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
              .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return (dealt.join(starts, "_range").withColumn("number", F.col("_start") + within - 1)
            .drop("_range", "_start"))


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``sources`` (source, source_size) with their ``target`` in words.

    The targets share ``share`` times all words by weight; ``weights`` repeat in the order of
    the sources. A target stops at ``most`` times its source, and what is above goes to the
    others by weight until none is above. Each round asks Spark for two sums.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.col("number") % len(weights) + 1).cast("int"))
    weighed = written(ranked(sources).withColumn("weight", weight), "mix-sources")
    total = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    cap, level, full = most * F.col("source_size"), 0.0, -1
    while True:
        above = F.lit(level) * F.col("weight") >= cap
        now, taken, open_weight = weighed.agg(
            F.count_if(above), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if now == full or not open_weight:
            break
        full, level = now, (total - (taken or 0.0)) / open_weight
    target = cap if not open_weight else F.least(F.lit(level) * F.col("weight"), cap)
    return weighed.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0))


def units(documents: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """What is decided on: doc_id, source, size, digest and the number of equal ``rows``."""
    return (documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                             F.size(words(F.col(text))).cast("long").alias("size"),
                             F.xxhash64(F.col(text)).alias("digest"))
            .groupBy("doc_id", "source", "size", "digest").agg(F.count(F.lit(1)).alias("rows")))


def mix(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
        seed: str = "mix", block: int = 2048) -> DataFrame:
    """How often each document is taken: doc_id, source, size, digest, source_size, target,
    copies and taken (size times copies), one row per document.

    Sizes are words. A document is taken ``target / source_size`` times on average, rounded
    down or up, so at most ``most`` times; words and documents of each source are balanced.
    Only ids, sizes and hashes are shuffled. A block is chosen by a hash of the document and
    holds about ``block`` documents; at most two of a block stay open, and 2048 blocks' open
    ones fly again, so the number of rounds is a logarithm of the documents and no task sees a
    whole source. The result depends on the rows and ``seed``, not on how rows are dealt out.

    A null text has no words; documents without words are taken as others are, for nothing. A
    null source is a source of its own, after the others. Rows of equal id, source and text are
    settled as far as their number allows before one of them flies; null ids are ids like
    others. An empty table gives no rows. Extra columns are ignored.
    """
    decided = written(units(documents, doc_id, text, source), "mix-units")
    sources = decided.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"),
                                            F.count(F.lit(1)).alias("units"))
    aims = written(targets(sources, weights, share, most).select(
        F.struct("source").alias("_source"), "number", "source_size", "target",
        F.ceil(F.col("units") / block).alias("blocks")), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    high = F.col("rows") * (F.col("rate") - F.col("low"))
    placed = (decided.withColumn("_source", F.struct("source")).join(aims, "_source").drop("_source")
              .withColumn("rate", rate).withColumn("low", F.floor("rate"))
              .withColumn("high", F.floor(high + SETTLED))
              .withColumn("chance", F.greatest(high - F.col("high"), F.lit(0.0))).drop("rate")
              .withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "digest"), "blocks")))
    placed = written(placed, "mix-placed")
    chance = F.col("chance")
    results = [placed.where(chance <= SETTLED)]
    waiting, blocks = placed.where(chance > SETTLED), aims.agg(F.max("blocks")).first()[0]
    while blocks:
        flown = written(waiting.groupBy("number", "block")
                        .applyInArrow(settled(seed), placed.schema), "mix-flown")
        results.append(flown.where((chance == 0) | (chance == 1)))
        waiting = flown.where((chance > 0) & (chance < 1)).withColumns({
            "block": F.floor(F.col("block") / block), "blocks": F.ceil(F.col("blocks") / block)})
        blocks = -(-blocks // block) if blocks > 1 else 0
    every = results[0]
    for result in results[1:]:
        every = every.unionByName(result)
    upper = F.col("high") + chance.cast("long")
    sides = F.filter(F.array(
        F.struct((F.col("low") + 1).alias("copies"), upper.alias("rows")),
        F.struct(F.col("low").alias("copies"), (F.col("rows") - upper).alias("rows"))),
        lambda side: side["rows"] > 0)
    kept = ["doc_id", "source", "size", "digest", "source_size", "target"]
    return (every.select(*kept, F.explode(sides).alias("side"))
            .select(*kept, "side.copies", _repeat(F.col("side.rows")))
            .select(*kept, "copies", (F.col("size") * F.col("copies")).alias("taken"),
                    F.explode(F.array_repeat(F.lit(0), F.col("part").cast("int"))).alias("_row"))
            .drop("_row"))


def _repeat(rows):
    """Row counts of bounded parts that add up to ``rows``."""
    parts = F.sequence(F.lit(0), F.floor((rows - 1) / REPEATS))
    return F.explode(F.transform(parts, lambda n: F.least(rows - n * REPEATS, F.lit(REPEATS)))).alias("part")


def mixed(documents: DataFrame, decisions: DataFrame, doc_id: str = "doc_id", text: str = "text",
          source: str = "source") -> DataFrame:
    """The mixture itself: all columns of ``documents``, each document as often as it is taken.

    Of rows of equal id, source and text the other columns come from one of them; they are
    reduced to one before they meet the decisions, so a hot group's texts are not shuffled.
    """
    key = F.struct(F.col(doc_id).alias("i"), F.col(source).alias("s"),
                   F.size(words(F.col(text))).cast("long").alias("n"),
                   F.xxhash64(F.col(text)).alias("d"))
    row = F.struct(*documents.columns)
    one = documents.groupBy(key.alias("_key")).agg(F.any_value(row).alias("_document"))
    chosen = decisions.where(F.col("copies") > 0).select(
        F.struct(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("n"),
                 F.col("digest").alias("d")).alias("_key"), "copies")
    repeated = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")
    return one.join(chosen, "_key").select("_document", repeated).select("_document.*")
