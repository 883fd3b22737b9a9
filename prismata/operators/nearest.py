"""Nearest box on a grid whose cells double until the bound holds.

Boxes are listed in all cells they touch; the first cell size is chosen from the boxes so that there are about eight entries
a box at most. A box looks into its own cells and those around them. What lies elsewhere is farther than one cell side, so a
distance up to that side is final; the other boxes look again with cells of twice the side. Boxes that look again
have nobody within half a side, so few of them share a cell and the work of a round is proportional to the boxes.
Equal boxes of an image are one entry (their distance is 0), whatever their number.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismata.plans.shared import materialize

SIDES = ["min_row", "max_row", "min_col", "max_col"]


def _gap(a: str, b: str) -> Column:
    gap = lambda lo, hi: F.greatest(F.lit(0), F.col(f"{a}.{lo}") - F.col(f"{b}.{hi}"), F.col(f"{b}.{lo}") - F.col(f"{a}.{hi}"))
    return F.hypot(gap("min_row", "max_row").cast("double"), gap("min_col", "max_col").cast("double"))


def _cells(df: DataFrame, side: float, around: int) -> DataFrame:
    cell = lambda c, by: (F.floor(F.col(c) / side) + by).cast("long")
    rows, cols = (F.sequence(cell(f"min_{x}", -around), cell(f"max_{x}", around)) for x in ("row", "col"))
    return df.withColumn("_r", F.explode(rows)).withColumn("_c", F.explode(cols))


def _first_side(distinct: DataFrame) -> tuple[float, float]:
    """The side at which the entries, at most (h / side + 1)(w / side + 1) a box, are 8 a box on average; and the extent of
    the largest image."""
    h, w = (F.col(f"max_{x}") - F.col(f"min_{x}") + 1.0 for x in ("row", "col"))
    n, area, around = distinct.agg(F.count("*"), F.sum(h * w), F.sum(h + w)).first()
    far = distinct.groupBy("image").agg(*[F.min(c).alias(c) if c.startswith("min") else F.max(c).alias(c) for c in SIDES]).agg(F.max(F.greatest(h, w))).first()[0]
    if not n:
        return 1.0, 0.0
    return max(1.0, (around + math.sqrt(around * around + 28 * n * area)) / (14 * n)), far


def nearest(boxes: DataFrame, image: str, key: str) -> DataFrame:
    """``image, key, nearest, nearest_key``: the gap between each box and the nearest other box of its image (hypotenuse of
    row and column gaps, 0 where they overlap), and the smallest key at that distance; for equal boxes the smallest key of them,
    and for that one the largest. Infinite and NULL for a single box. Keys are unique in an image; a box with a NULL side has
    NULLs."""
    known = " AND ".join(f"{c} IS NOT NULL" for c in SIDES)
    rows = materialize(boxes.select(F.col(image).alias("image"), F.col(key).alias("key"), *SIDES), "boxes")
    distinct = rows.where(known).groupBy("image", *SIDES).agg(F.count("*").alias("n"), F.min("key").alias("key"), F.max("key").alias("last"))
    distinct = materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-boxes")
    side, far = _first_side(distinct)
    todo, parts = distinct.where("n = 1"), []
    while True:
        a, b = _cells(todo, side, 1).alias("a"), _cells(distinct, side, 0).alias("b")
        meet = a.join(b, F.col("a.image").eqNullSafe(F.col("b.image")) & (F.col("a._r") == F.col("b._r")) & (F.col("a._c") == F.col("b._c")) & (F.col("a.id") != F.col("b.id")))
        best = meet.groupBy(F.col("a.id").alias("id")).agg(F.min(F.struct(_gap("a", "b").alias("d"), F.col("b.key").alias("k"))).alias("_m"))
        looked = materialize(todo.join(best, "id", "left").withColumn("_done", F.coalesce(F.col("_m.d") <= side, F.lit(side >= far))), "nearest-round")
        parts.append(looked.where("_done").select("image", *SIDES, F.coalesce("_m.d", F.lit(float("inf"))).alias("nearest"), F.col("_m.k").alias("nearest_key")))
        todo = looked.where("NOT _done").drop("_m", "_done")
        if side >= far or todo.isEmpty():
            break
        side *= 2
    found = reduce(DataFrame.unionByName, parts)
    same = lambda other: reduce(lambda p, q: p & q, [F.col(f"x.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in ("image", *SIDES)])
    twins = distinct.where("n > 1").select("image", *SIDES, F.col("key").alias("first"), "last")
    x = rows.alias("x").join(found.alias("y"), same("y"), "left").join(twins.alias("z"), same("z"), "left")
    twin = F.col("z.first").isNotNull()
    other = F.when(F.col("x.key") == F.col("z.first"), F.col("z.last")).otherwise(F.col("z.first"))
    return x.select(F.col("x.image").alias(image), F.col("x.key").alias(key), F.when(twin, 0.0).otherwise(F.col("y.nearest")).alias("nearest"), F.when(twin, other).otherwise(F.col("y.nearest_key")).alias("nearest_key"))
