"""Words as 64-bit hashes, and rolling hashes of word windows.

Words are split and hashed by Spark's functions and reach Python as arrays of longs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
NOT_ALPHANUMERIC = r"[^\p{L}\p{N}]+"
FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words(text: Column, separator: str = SPACES) -> Column:
    """The words of the whole text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def hashes(values: Column) -> Column:
    return F.transform(values, lambda word: F.xxhash64(word))


def lists(array: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of an array of hashes as unsigned numbers, and where each row starts."""
    offsets = np.asarray(array.offsets, dtype=np.int64)
    values = np.asarray(array.values, dtype=np.int64)[offsets[0]:offsets[-1]] if len(array) else (
        np.zeros(0, np.int64))
    return values.view(np.uint64), offsets - (offsets[0] if len(array) else 0)


def slices(batches, most: int = 1 << 20):
    """The batches cut so that a part holds about ``most`` hashes in its column ``words``."""
    for batch in batches:
        _, starts = lists(batch.column("words"))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(starts, starts[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(32))
    values = values * FIRST
    return values ^ (values >> np.uint64(29))


def windows(values: np.ndarray, size: int, factor: np.uint64 = SECOND) -> np.ndarray:
    """A hash of each ``size`` consecutive values; none if there are fewer.

    Built by doubling, so the work is logarithmic in ``size``: a window of a power of two is
    two halves, any other one is made of its binary parts.
    """
    count = len(values) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total, done = None, 0
    power, width = values, 1
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                part = power[done:done + count]
                total = part if total is None else mix(total * factor + part)
                done += width
            if done == size:
                return mix(total)
            power = mix(power[:-width] * factor + power[width:])
            width *= 2


def shingle_set(values: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of ``size`` words, sorted; a shorter text is one shingle as a whole."""
    if len(values) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(windows(values, min(size, len(values))))
