"""What both k-means operators need: vectors as whole numbers, exact squared distances, batches of a useful size.

A component x becomes floor(scale * x), and one beyond limit_of(length) the limit: a sum of that many squared differences
then stays below 2**62, so distances are exact 64-bit numbers whatever the vectors hold. For 64 components the limit is 2**27.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CELLS = 1 << 20  # numbers that one step works on
LONGEST = (1 << 63) - 1


def limit_of(length: int) -> int:
    return math.isqrt((1 << 62) // max(1, length)) // 2


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """Rows of doubles as rows of 64-bit integers."""
    top = limit_of(x.shape[1])
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -top, top).astype(np.int64)


def finite(vector: str) -> Column:
    """True where the vector and all its components are there and finite."""
    x = F.col(vector)
    return x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x (..., n, d) to rows of c (..., k, d), integers both."""
    top = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * x.shape[-1] * int(top) ** 2 < 1 << 53:  # all sums are whole numbers that a double holds
        x, c = x.astype(np.float64), c.astype(np.float64)
    cross = x @ np.swapaxes(c, -1, -2)
    return ((x * x).sum(axis=-1)[..., :, None] - 2 * cross + (c * c).sum(axis=-1)[..., None, :]).astype(np.int64)


def blocks(batches: Iterable[pa.RecordBatch], vector: str) -> Iterator[pa.Table]:
    """Batches put together until their vectors hold about CELLS numbers."""
    held, cells = [], 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        cells += len(b[vector].flatten())
        if cells >= CELLS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, cells = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def lists(rows: np.ndarray) -> pa.ListArray:
    """Rows of integers as an Arrow column of lists."""
    ends = np.arange(0, rows.size + 1, rows.shape[1]) if rows.shape[1] else np.zeros(len(rows) + 1, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows.ravel().astype(np.int32), pa.int32()))


def capped(total: int) -> int:
    """A sum as a long: one that no long holds is the largest."""
    return min(int(total), LONGEST)
