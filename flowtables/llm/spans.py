"""Positions of pattern matches, and texts rebuilt around them, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values per block of a running total, and code points per block of a text.
BLOCK = 512
CONTEXT = 80


def running(values: Column, step: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each item the total of all items before it. Blocks keep the work far below quadratic."""
    def prefixes(items: Column, start: Column) -> Column:
        """Totals before each item and after the last, so one more than items."""
        return F.aggregate(items, F.array(start), lambda done, item: F.concat(
            done, F.array(step(F.element_at(done, -1), item))))

    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))),
        lambda at: F.slice(values, at * BLOCK + 1, F.lit(BLOCK)))
    totals = F.transform(blocks, lambda block: F.aggregate(block, zero, step))
    starts = prefixes(totals, zero)
    inside = F.zip_with(F.slice(starts, F.lit(1), F.size(blocks)), blocks,
                        lambda start, block: F.slice(prefixes(block, start), F.lit(1), F.size(block)))
    return F.flatten(inside)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str, searched: Column | None = None) -> Column:
    """Array of (start, end, found, before, after): leftmost matches that do not overlap, in code
    points.

    ``searched`` is the text with characters exchanged one for one that is searched instead;
    ``before`` and ``after`` are the text between a match and its neighbours, at most the
    ``CONTEXT`` code points next to it.
    """
    searched = text if searched is None else searched

    def placed(pairs: Column) -> Column:
        steps = F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["found"]))
        starts = running(steps, lambda a, b: a + b, F.lit(0))
        return F.zip_with(pairs, starts, lambda p, start: F.struct(
            (start + F.length(p["gap"])).alias("start"),
            (start + F.length(p["gap"]) + F.length(p["found"])).alias("end"),
            p["found"].alias("found"),
            F.right(p["gap"], F.lit(CONTEXT)).alias("before"),
            F.left(p["next"], F.lit(CONTEXT)).alias("after")))

    def paired(both: Column) -> Column:
        count = F.size(both["found"])
        return F.arrays_zip(F.slice(both["gaps"], F.lit(1), count).alias("gap"),
                            F.slice(both["gaps"], F.lit(2), count).alias("next"),
                            both["found"].alias("found"))

    both = F.struct(F.regexp_extract_all(searched, F.lit(pattern), F.lit(0)).alias("found"),
                    F.split(searched, pattern, -1).alias("gaps"))
    return once(once(both, paired), placed)


def masked(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """``text`` with each span, ordered by start, replaced by its label.

    Of spans that overlap, the first one's label stands for all that they cover together.
    """
    size = 8 * BLOCK
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))

    def piece(start: Column, end: Column) -> Column:
        first = F.floor(start / size).cast("int")
        last = F.floor((end - 1) / size).cast("int")
        joined = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
        return F.when(end > start, F.substring(joined, start - first * size + 1, end - start)
                      ).otherwise(F.lit(""))

    reached = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
    kept = F.zip_with(spans, reached, lambda s, done: F.concat(
        piece(done, s["start"]), F.when(s["start"] >= done, label(s)).otherwise(F.lit(""))))
    rest = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(F.array_join(kept, ""), piece(rest, F.length(text))))
