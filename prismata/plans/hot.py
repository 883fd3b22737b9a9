"""Equi-joins whose hot keys do not meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE, LEAST = 1000, 64


def join_hot(big: DataFrame, small: DataFrame, keys: str | list[str], total: int, n: str = "n") -> DataFrame:
    """``big`` joined with ``small`` by ``keys``, which are unique there; column ``n`` of ``small`` says how many rows
    of ``big`` have the key, ``total`` how many rows all keys together have (at least).

    Keys of more than ``total / SHARE`` rows (and more than LEAST) are at most SHARE keys, whatever the input: these rows
    are broadcast and their side of ``big`` is not shuffled. All other rows take a plain join.
    """
    keys = [keys] if isinstance(keys, str) else keys
    hot = F.col(n) > max(LEAST, total // SHARE)
    few = small.where(hot)  # SHARE rows at most
    return big.join(F.broadcast(few), keys).unionByName(big.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(small.where(~hot), keys))
