"""Raster operators on pixel tables: a mask is the set of its (image, row, col) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.operators import runs, tiles
from prismata.plans.nulls import join_same

AT = ["image", "row", "col"]


def _disk(radius: int) -> list[tuple[int, int]]:
    r = range(-radius, radius + 1)
    return [(a, b) for a in r for b in r if a * a + b * b <= radius * radius]


def dilate(mask: DataFrame, radius: int, within: DataFrame | None = None) -> DataFrame:
    """``within`` bounds the raster: only its pixels come back."""
    out = runs.pixels(runs.dilate(runs.runs(mask), radius))
    return join_same(out, within.select(*AT), AT, "left_semi") if within is not None else out


def erode(mask: DataFrame, radius: int, bounds: DataFrame | None = None) -> DataFrame:
    """Pixels whose whole disk is in the mask; what lies outside the raster is background, or, with ``bounds`` (or the
    runs of its pixels), not asked."""
    return runs.pixels(runs.erode(runs.runs(mask), radius, bounds))


def opening(mask: DataFrame, radius: int, bounds: DataFrame | None = None) -> DataFrame:
    return runs.pixels(runs.opening(runs.runs(mask), radius, bounds))


def closing(mask: DataFrame, radius: int, bounds: DataFrame | None = None) -> DataFrame:
    return runs.pixels(runs.closing(runs.runs(mask), radius, bounds))


def components(mask: DataFrame, connectivity: int = 8) -> DataFrame:
    """``(image, row, col, label)``: label is the smallest pixel code of the component."""
    return tiles.components(mask, connectivity)


def component_table(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("image", "label").agg(F.count("*").alias("area"), F.avg("row").alias("centre_row"), F.avg("col").alias("centre_col"), F.min("row").alias("min_row"), F.min("col").alias("min_col"), F.max("row").alias("max_row"), F.max("col").alias("max_col"))


def remove_small(labelled: DataFrame, least: int) -> DataFrame:
    keep = labelled.groupBy("image", "label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return join_same(labelled, keep.select("image", "label"), ["image", "label"], "left_semi")


def mask_agreement(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Pixel agreement, Dice and IoU; two empty masks agree fully."""
    x, y = F.col(a), F.col(b)
    both, either, n = F.count_if(x & y), F.count_if(x | y), F.count("*")
    total = F.count_if(x) + F.count_if(y)
    return df.groupBy(*by).agg((F.count_if(x == y) / n).alias("agreement"), F.when(total == 0, 1.0).otherwise(F.try_divide(2 * both, total)).alias("dice"), F.when(either == 0, 1.0).otherwise(F.try_divide(both, either)).alias("iou"))


def component_iou(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """IoU of every overlapping pair of labels, from pixel counts: no pair without overlap is made."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").alias("overlap"))
    area_a = df.where(F.col(a).isNotNull()).groupBy(*by, a).agg(F.count("*").alias("area_a"))
    area_b = df.where(F.col(b).isNotNull()).groupBy(*by, b).agg(F.count("*").alias("area_b"))
    out = join_same(join_same(pairs, area_a, [*by, a]), area_b, [*by, b])
    return out.withColumn("iou", F.col("overlap") / (F.col("area_a") + F.col("area_b") - F.col("overlap")))


def error_codes(df: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """0 none, 1 TP, 2 TN, 3 FP, 4 FN."""
    t, p = F.col(truth), F.col(prediction)
    return df.withColumn("code", F.when(t.isNull() | p.isNull(), 0).when(t & p, 1).when(~t & ~p, 2).when(~t & p, 3).otherwise(4))


def fill_holes(mask: DataFrame, within: DataFrame) -> DataFrame:
    """The mask and its holes: background components, by edges only, that do not reach the border of the raster.
    ``within`` holds all pixels of each raster; its extreme rows and columns are the border."""
    border = within.groupBy("image").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    background = components(join_same(within.select(*AT), mask.select(*AT), AT, "left_anti"), 4)
    on_border = F.col("row").isin(F.col("r0"), F.col("r1")) | F.col("col").isin(F.col("c0"), F.col("c1"))
    outside = join_same(background, border, ["image"]).where(on_border).select("image", "label").distinct()
    return mask.select(*AT).unionByName(join_same(background, outside, ["image", "label"], "left_anti").select(*AT))


def clean_mask(mask: DataFrame, within: DataFrame, least: int = 20, opening_radius: int = 0, closing_radius: int = 1, holes: bool = True, connectivity: int = 4) -> DataFrame:
    """Opening, closing, holes, then components under ``least`` pixels go; a radius of 0 leaves a step out. ``within`` holds
    all pixels of each raster: beyond its edges there is neither mask nor background."""
    edge, out = runs.runs(within), runs.runs(mask)
    if opening_radius:
        out = runs.opening(out, opening_radius, edge)
    if closing_radius:
        out = runs.closing(out, closing_radius, edge)
    out = join_same(runs.pixels(out), within.select(*AT), AT, "left_semi")
    if holes:
        out = fill_holes(out, within)
    return remove_small(components(out, connectivity), least).select(*AT)


def manual_labels(labelled: DataFrame, manual: DataFrame) -> DataFrame:
    """``manual(image, row, col, manual)`` decides where it has a row: its label replaces that of the pixel, and a NULL
    takes the pixel out of its component."""
    m = manual.select(*AT, "manual", F.lit(True).alias("_by_hand"))
    out = join_same(labelled, m, AT, "left").withColumn("label", F.when(F.col("_by_hand"), F.col("manual")).otherwise(F.col("label")))
    return out.drop("manual", "_by_hand").where("label IS NOT NULL")
