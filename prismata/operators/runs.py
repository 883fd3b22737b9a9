"""Masks as runs: ``(image, row, c0, c1)``, the stretches of a row that belong to the mask, without overlap or contact.

Morphology with a disk works on runs. A row of the disk at distance d widens a run by the half-width there (dilation), or
narrows it (erosion), so a run gives 2 radius + 1 rows whatever its length; unions and intersections are sweeps over the ends
of one raster row at a time.

``bounds(image, r0, r1, c0, c1)`` names the raster of each image and sets the border rule. With it the raster is all there is: a
dilation ends at its edge, and an erosion asks only the part of the disk that lies inside (mirrored borders give the same).
A raster that is no full rectangle is given by the runs of its pixels instead (``runs`` of all of them); its gaps and what lies
beyond are not asked either. Without a raster the plane goes on, and what is outside is background. An image that the raster
does not name gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN = ["image", "row", "c0", "c1"]
FAR = 1 << 30


def bounds(pixels: DataFrame) -> DataFrame:
    """The smallest raster of each image that holds all its pixels."""
    return pixels.groupBy("image").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))


def runs(mask: DataFrame) -> DataFrame:
    """Runs of a mask of pixels; a repeated pixel counts once."""
    line = Window.partitionBy("image", "row").orderBy("col")
    cut = mask.select("image", "row", "col").withColumn("_s", F.col("col") - F.dense_rank().over(line))
    return cut.groupBy("image", "row", "_s").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).select(*RUN)


def pixels(found: DataFrame) -> DataFrame:
    return found.select("image", "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def _half_widths(radius: int) -> list[tuple[int, int]]:
    return [(d, math.isqrt(radius * radius - d * d)) for d in range(-radius, radius + 1)]


def _rows_of_disk(radius: int):
    return F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in _half_widths(radius)])).alias("o")


def union(found: DataFrame) -> DataFrame:
    """Runs that overlap or touch become one."""
    line = Window.partitionBy("image", "row").orderBy("c0", "c1")
    before = F.max("c1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.select(*RUN, F.when(before >= F.col("c0") - 1, 0).otherwise(1).alias("_new"))
    named = marked.withColumn("_k", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy("image", "row", "_k").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).select(*RUN)


def _sweep(a: DataFrame, b: DataFrame, in_b: bool) -> DataFrame:
    """Stretches of runs of ``a`` that lie in runs of ``b`` (or, without ``in_b``, outside them)."""
    ends = [F.explode(F.array(F.struct(F.col("c0").alias("at"), F.lit(1).alias("step")), F.struct((F.col("c1") + 1).alias("at"), F.lit(-1).alias("step")))).alias("e"), F.col("image"), F.col("row")]
    one, none = F.col("e.step"), F.lit(0)
    steps = a.select(*ends).select("image", "row", "e.at", one.alias("a"), none.alias("b")).unionByName(b.select(*ends).select("image", "row", "e.at", none.alias("a"), one.alias("b")))
    # dealt by an exchange of their own: the union of Spark 4.1 keeps its inputs' partitioning, and lost rows where exchanges were reused
    steps = steps.repartition("image", "row")
    line = Window.partitionBy("image", "row").orderBy("at")
    level = steps.groupBy("image", "row", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    level = level.select("image", "row", F.col("at").alias("c0"), (F.lead("at").over(line) - 1).alias("c1"), F.sum("a").over(line).alias("_a"), F.sum("b").over(line).alias("_b"))
    return union(level.where((F.col("_a") > 0) & ((F.col("_b") > 0) == in_b)).select(*RUN))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sweep(a, b, True)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sweep(a, b, False)


def _in(found: DataFrame, raster: DataFrame) -> DataFrame:
    b = raster.select(F.col("image").alias("_image"), F.col("r0").alias("_r0"), F.col("r1").alias("_r1"), F.col("c0").alias("_c0"), F.col("c1").alias("_c1"))
    return found.join(b, F.col("image").eqNullSafe(F.col("_image"))).drop("_image")  # a row an image


def dilate(found: DataFrame, radius: int, raster: DataFrame | None = None) -> DataFrame:
    o = found.select(*RUN, _rows_of_disk(radius))
    out = union(o.select("image", (F.col("row") + F.col("o.d")).alias("row"), (F.col("c0") - F.col("o.w")).alias("c0"), (F.col("c1") + F.col("o.w")).alias("c1")))
    if raster is None:
        return out
    if "row" in raster.columns:
        return common(out, raster)
    cut = _in(out, raster).where("row BETWEEN _r0 AND _r1 AND c1 >= _c0 AND c0 <= _c1")
    return cut.select("image", "row", F.greatest("c0", "_c0").alias("c0"), F.least("c1", "_c1").alias("c1"))


def erode(found: DataFrame, radius: int, raster: DataFrame | None = None) -> DataFrame:
    """What keeps its whole disk. Every row of the disk covers a column at most once, so a column stays where as many rows
    cover it as there are."""
    if raster is not None and "row" in raster.columns:
        return minus(common(found, raster), dilate(minus(raster, found), radius))
    c0, c1, wanted = F.col("c0"), F.col("c1"), F.lit(2 * radius + 1)
    if raster is not None:
        found = _in(found, raster).where("row BETWEEN _r0 AND _r1")
        # what ends at the edge of the raster goes on beyond it
        found = found.withColumns({"c0": F.when(c0 <= F.col("_c0"), -FAR).otherwise(c0), "c1": F.when(c1 >= F.col("_c1"), FAR).otherwise(c1)})
        found = found.select(*RUN, F.struct("_r0", "_r1", "_c0", "_c1").alias("_b"))
    else:
        found = found.select(*RUN, F.lit(None).cast("struct<_r0: int, _r1: int, _c0: int, _c1: int>").alias("_b"))
    o = found.select(*RUN, "_b", _rows_of_disk(radius))
    o = o.select("image", (F.col("row") - F.col("o.d")).alias("row"), (F.col("c0") + F.col("o.w")).alias("c0"), (F.col("c1") - F.col("o.w")).alias("c1"), "_b").where("c0 <= c1")
    if raster is not None:
        o = o.where("row BETWEEN _b._r0 AND _b._r1")
        wanted = F.least(F.col("row") + radius, F.col("_b._r1")) - F.greatest(F.col("row") - radius, F.col("_b._r0")) + 1
    ends = o.select("image", "row", "_b", F.explode(F.array(F.struct(F.col("c0").alias("at"), F.lit(1).alias("step")), F.struct((F.col("c1") + 1).alias("at"), F.lit(-1).alias("step")))).alias("e"))
    steps = ends.groupBy("image", "row", "_b", F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step"))
    line = Window.partitionBy("image", "row").orderBy("at")
    level = steps.select("image", "row", "_b", F.col("at").alias("c0"), (F.lead("at").over(line) - 1).alias("c1"), F.sum("step").over(line).alias("_n"))
    kept = level.where(F.col("_n") == wanted)
    if raster is not None:
        kept = kept.withColumns({"c0": F.greatest("c0", "_b._c0"), "c1": F.least("c1", "_b._c1")}).where("c0 <= c1")
    # a level may change and come back at one place, so kept stretches may touch
    return union(kept.select(*RUN))


def opening(found: DataFrame, radius: int, raster: DataFrame | None = None) -> DataFrame:
    return dilate(erode(found, radius, raster), radius, raster)


def closing(found: DataFrame, radius: int, raster: DataFrame | None = None) -> DataFrame:
    return erode(dilate(found, radius, raster), radius, raster)
