"""Operators that differ between streams and batch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtables.operators.aggregates import first_occurrence, topk
from flowtables.operators.joins import left_join_as_of
from flowtables.streaming.runs import append_changes


def first_changes(stream: DataFrame, folder: str, keys: list[str], order: str):
    """First rows without state: log each batch's own first row per key.

    The first of all rows is among the first of the batches, so :func:`first_table` over the
    log is exact, however far apart a key's rows are.
    """
    return append_changes(stream, folder,
                          per_batch=lambda batch: first_occurrence(batch, keys, order))


def first_table(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of every key of a log of :func:`first_changes`."""
    return first_occurrence(changes.drop("batch_id"), keys, order)


def topk_changes(stream: DataFrame, folder: str, keys: list[str], value: Column, k: int,
                 name: str):
    """Top-k without state: log each batch's own top-k.

    The k largest of all rows are among the k largest of the batches, so
    :func:`topk_table` over the log is exact.
    """
    def best(batch: DataFrame) -> DataFrame:
        return topk(batch, keys, value, k, name)

    return append_changes(stream, folder, per_batch=best)


def topk_table(changes: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """The k largest per key. Written to a folder, the result stands for the log it was made of."""
    rows = changes.select(*keys, F.explode_outer(name).alias("_value"))
    return topk(rows, keys, F.col("_value"), k, name)


def join_refreshed(stream: DataFrame, read_table, on: str, folder: str):
    """Left join against a table that changes: re-read it for every micro-batch."""
    def joined(batch: DataFrame) -> DataFrame:
        return batch.join(read_table(), on, "left")

    return append_changes(stream, folder, per_batch=joined)


def join_as_of(stream: DataFrame, read_versions, on: list[str], at: str, since: str, folder: str,
               **options):
    """Left join of a stream with the table rows valid at each event's time.

    The versions are read anew for every micro-batch. A version that arrives late counts for the
    batches after it; rows that were joined before keep what they were joined with.
    """
    def joined(batch: DataFrame) -> DataFrame:
        return left_join_as_of(batch, read_versions(), on, at, since, **options)

    return append_changes(stream, folder, per_batch=joined)
