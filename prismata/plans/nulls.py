"""Joins by keys in which NULL equals NULL, as in a GROUP BY."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The columns of ``left``, and those of ``right`` that are not keys (none for a semi or anti join). Without keys all rows
    meet, which is meant for a ``right`` of one row."""
    other = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    if not keys:
        return left.join(F.broadcast(other), F.lit(True), how)  # one row
    return left.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys]), how).drop(*[f"_same_{k}" for k in keys])
