"""Quality of objects: geometry, neighbours, spectra of their pixels, and what follows for their use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.functions import spectra as sp
from prismata.operators import nearest
from prismata.plans.nulls import join_same


def _zero_variance(pixels: DataFrame, by: list[str], spectrum: str, eps: float) -> DataFrame:
    bands = pixels.select(*by, F.posexplode(spectrum).alias("_band", "_v")).groupBy(*by, "_band").agg(F.var_pop("_v").alias("_var"))
    return bands.groupBy(*by).agg(F.avg((F.col("_var") <= eps).cast("double")).alias("zero_variance_band_rate"))


def object_table(pixels: DataFrame, item: str, spectrum: str = "spectrum", least_area: int = 20, least_fill: float = 0.45, least_gap: float = 2.0, margin: int = 0, eps: float = 1e-12) -> DataFrame:
    """One row per image and object of ``pixels(image, row, col, item, spectrum)``; rows without an object only belong to
    the image's raster. Boxes are half open: ``max_row`` and ``max_col`` are the first beyond.

    ``possible_merged``: the object fills too little of its box, or another box is too near (infinite for a single object).
    ``qc_status`` is excluded with values that are not finite, without a valid pixel or with too small an area, warning where
    objects may be merged or the image's border is touched, accepted otherwise.
    """
    s, by = F.col(spectrum), ["image", item]
    frame = pixels.groupBy("image").agg(F.min("row").alias("_r0"), (F.max("row") + 1).alias("_r1"), F.min("col").alias("_c0"), (F.max("col") + 1).alias("_c1"))
    reason = sp.validity_reason(s)
    size = lambda f: F.size(F.filter(s, f))
    own = pixels.where(F.col(item).isNotNull())
    out = own.groupBy(*by).agg(
        F.count("*").alias("area"), F.min("row").alias("min_row"), (F.max("row") + 1).alias("max_row"), F.min("col").alias("min_col"), (F.max("col") + 1).alias("max_col"), F.max(F.size(s)).alias("n_bands"),
        F.count_if(reason == "valid").alias("n_valid_pixels"), F.count_if(reason != "valid").alias("n_invalid_pixels"), F.count_if(reason == "all_zero_spectrum").alias("n_all_zero_pixels"), F.count_if(F.exists(s, lambda x: x <= 0)).alias("n_nonpositive_pixels"),
        F.sum(size(lambda x: F.isnan(x))).alias("n_nan"), F.sum(size(lambda x: F.abs(x) == float("inf"))).alias("n_inf"),
    )
    out = join_same(join_same(out, frame, ["image"]), _zero_variance(own, by, spectrum, eps), by, "left")
    out = join_same(out, nearest.nearest(out, "image", item).select("image", item, F.col("nearest").alias("nearest_object_distance"), F.col("nearest_key").alias("nearest_object")), by)
    touches = (F.col("min_row") <= F.col("_r0") + margin) | (F.col("max_row") >= F.col("_r1") - margin) | (F.col("min_col") <= F.col("_c0") + margin) | (F.col("max_col") >= F.col("_c1") - margin)
    out = out.withColumns({"fill_ratio": F.col("area") / ((F.col("max_row") - F.col("min_row")) * (F.col("max_col") - F.col("min_col"))), "touches_border": touches, "too_small": F.col("area") < least_area, "invalid_pixel_rate": F.col("n_invalid_pixels") / F.col("area")})
    out = out.withColumn("possible_merged", (F.col("fill_ratio") < least_fill) | (F.col("nearest_object_distance") < least_gap)).withColumn("needs_review", F.col("possible_merged") | F.col("too_small"))
    fatal = (F.col("n_nan") + F.col("n_inf") > 0) | (F.col("n_valid_pixels") == 0) | F.col("too_small")
    return out.withColumn("qc_status", F.when(fatal, "excluded").when(F.col("possible_merged") | F.col("touches_border"), "warning").otherwise("accepted")).drop("_r0", "_r1", "_c0", "_c1")


def warnings(table: DataFrame, item: str, most_invalid: float = 0.2) -> DataFrame:
    """A row per object and finding of ``object_table``: its name, severity (error, warning or info) and the value that says
    so."""
    rules = [
        ("not_finite", "error", F.col("n_nan") + F.col("n_inf") > 0, F.col("n_nan") + F.col("n_inf")),
        ("no_valid_pixel", "error", F.col("n_valid_pixels") == 0, F.col("n_valid_pixels")),
        ("too_small", "error", F.col("too_small"), F.col("area")),
        ("possible_merged", "warning", F.col("possible_merged"), F.col("fill_ratio")),
        ("touches_border", "warning", F.col("touches_border"), F.lit(1)),
        ("invalid_pixels", "info", F.col("invalid_pixel_rate") > most_invalid, F.col("invalid_pixel_rate")),
    ]
    found = F.array(*[F.when(when, F.struct(F.lit(n).alias("finding"), F.lit(level).alias("severity"), v.cast("double").alias("value"))) for n, level, when, v in rules])
    return table.select("image", item, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("image", item, "x.*")
