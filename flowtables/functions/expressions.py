"""Expressions that need more than one built-in call. All stay in the JVM.

Single-call functions (abs, ceil, lower, length, coalesce, ...) have no wrapper;
use ``pyspark.sql.functions`` for them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_literal(text: Column, delimiter: str) -> Column:
    """Split on a literal delimiter. Spark's own ``split`` takes a regular expression."""
    if len(delimiter) == 1:
        # One escaped character keeps the JVM's fast path, which needs no regex.
        return F.split(text, delimiter if delimiter.isalnum() else "\\" + delimiter)
    return F.split(text, re.escape(delimiter))


def item(container: Column, index) -> Column:
    """1-based array item or map value; null when it is missing."""
    return F.try_element_at(container, index if isinstance(index, Column) else F.lit(index))


def slice_to(array: Column, first: int | Column, last: int | Column) -> Column:
    """Items ``first`` to ``last``, both inclusive and 1-based."""
    first = F.lit(first) if isinstance(first, int) else first
    last = F.lit(last) if isinstance(last, int) else last
    return F.slice(array, first, F.greatest(last - first + 1, F.lit(0)))


def map_of(keys: Column, values: Column) -> Column:
    """Map from a key array and a value array.

    The shorter array is padded with null, null keys are left out and the last
    value of a repeated key wins. Sorting (key, position) pairs once keeps this
    at n log n for arrays of any length.
    """
    # Field names are literals here: aliases get lost beside an explode.
    ordered = F.sort_array(F.transform(keys, lambda key, at: F.named_struct(
        F.lit("key"), key, F.lit("at"), at)))

    def build(bound):
        pairs, value_array = bound["pairs"], bound["values"]

        def is_last(pair, at):
            following = F.get(pairs, at + 1)["key"]
            return pair["key"].isNotNull() & ~pair["key"].eqNullSafe(following)

        return F.map_from_entries(F.transform(
            F.filter(pairs, is_last),
            lambda pair: F.struct(pair["key"], F.get(value_array, pair["at"]))))

    # A one-element array binds both inputs to a lambda variable, so that they
    # are evaluated once per row and not once per element.
    bound = F.array(F.named_struct(F.lit("pairs"), ordered, F.lit("values"), values))
    return F.get(F.transform(bound, build), F.lit(0))


def next_item_map(array: Column) -> Column:
    """Map from each item to the item that follows its last occurrence."""
    return map_of(array, slice_to(array, F.lit(2), F.size(array)))


def map_text(entries: Column) -> Column:
    """A map as ``key=value`` text in key order, null values as ``null``."""
    sorted_entries = F.sort_array(F.map_entries(entries))
    return F.array_join(F.transform(sorted_entries, lambda e: F.concat(
        e["key"].cast("string"), F.lit("="),
        F.coalesce(e["value"].cast("string"), F.lit("null")))), ";")


def joined_text(*parts: Column) -> Column:
    """``a + b`` on strings; null when one part is null."""
    return F.concat(*[part.cast("string") for part in parts])


def whole_ratio(dividend: Column, divisor: Column) -> Column:
    """Integer division, truncated; null for a zero divisor."""
    return F.call_function("div", dividend, F.nullif(divisor, F.lit(0)))


def share(part: Column, whole: Column, digits: int) -> Column:
    """Rounded ratio of two counts as DOUBLE; null for an empty whole."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def text_to_millis(text: Column, pattern: str) -> Column:
    """Epoch milliseconds of a formatted time; null where it does not parse."""
    return F.unix_millis(F.try_to_timestamp(text, F.lit(pattern)))


def millis_to_text(millis: Column, pattern: str) -> Column:
    """Epoch milliseconds as formatted text in the session's time zone."""
    return F.date_format(F.timestamp_millis(millis), pattern)


def fingerprint(*columns: Column) -> Column:
    """URL-safe base64 of the SHA-256 over the columns' text.

    Each text stands behind its length, a null is ``-``: different rows give different texts.
    """
    def field(column):
        value = column.cast("string")
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    text = F.concat(*map(field, columns))
    return F.translate(F.base64(F.unhex(F.sha2(text, 256))), "+/", "-_")
