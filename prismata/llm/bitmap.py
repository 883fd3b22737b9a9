"""A bitmap that stands for a set of hashes: it lets every member through and few others, and an exact join follows.
It has 16 bits or more for each member, up to 2 ** MOST_BITS bits (16 MB, the bound of what is sent to executors). A
set of more than 2 ** (MOST_BITS - 4) members lets more other hashes through, up to all of them: results stay whole, and the
exact join then shuffles more."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 16, 27


def bitmap(hashes: DataFrame, column: str = "h") -> np.ndarray:
    """64-bit words of the bitmap; at most 2 ** (MOST_BITS - 6) aggregated rows come to the driver, as Arrow columns."""
    n = hashes.where(F.col(column).isNotNull()).count()
    bits = min(MOST_BITS, max(LEAST_BITS, n.bit_length() + 4))
    cell = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = hashes.where(F.col(column).isNotNull()).select(cell.alias("c")).select(F.shiftright("c", 6).alias("at"), F.expr("shiftleft(1L, cast(c & 63 AS int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    c = h & np.uint64(len(bits) * 64 - 1)
    return (bits[(c >> np.uint64(6)).astype(np.int64)] >> (c & np.uint64(63))) & np.uint64(1) == 1
