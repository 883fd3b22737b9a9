"""Observation matrices from pixel tables, samples of them, and band-wise quality tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismata.operators import nearest
from prismata.plans.nulls import join_same


def object_matrix(pixels: DataFrame, keys: list[str], spectrum: str = "spectrum", median: bool = False) -> DataFrame:
    """One row per object: the band-wise mean or median of its pixels."""
    value = F.percentile("v", 0.5) if median else F.avg("v")
    long = pixels.select(*keys, F.posexplode(spectrum).alias("band", "v")).groupBy(*keys, "band").agg(value.alias("v"))
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "v"))), lambda x: x["v"]).alias(spectrum))


def balanced_pixels(pixels: DataFrame, by: list[str], m: int, order: Column, policy: str = "short") -> DataFrame:
    """m pixels per object in the given order (a seeded hash or a distance). Objects with fewer: ``short`` keeps what
    there is, ``exclude`` drops them."""
    w = Window.partitionBy(*by)
    df = pixels.withColumns({"draw": F.row_number().over(w.orderBy(order)), "n_available": F.count("*").over(w)}).where(F.col("draw") <= m)
    return df.where(F.col("n_available") >= m) if policy == "exclude" else df


def coverage(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"))


def balance_ratio(df: DataFrame, by: list[str]) -> DataFrame:
    return coverage(df, by).agg((F.min("n_rows") / F.max("n_rows")).alias("balance_ratio"), F.count("*").alias("n_groups"))


def selection_overlap(selected: DataFrame, item: str, seed: str, pixel: str) -> DataFrame:
    """Mean Jaccard of an object's selected pixels over pairs of seeds; a seed's selection per object is bounded by m."""
    sets = selected.groupBy(item, seed).agg(F.collect_set(pixel).alias("s"))
    pairs = sets.alias("a").join(sets.alias("b"), (F.col(f"a.{item}") == F.col(f"b.{item}")) & (F.col(f"a.{seed}") < F.col(f"b.{seed}")))
    return pairs.agg(F.avg(F.size(F.array_intersect("a.s", "b.s")) / F.size(F.array_union("a.s", "b.s"))).alias("mean_overlap"), F.count("*").alias("n_pairs"))


def evenly_spaced(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """At most n rows per group at even positions from first to last."""
    w = Window.partitionBy(*by)
    df = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    slot = F.floor(F.col("_i") * (n - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    before = F.floor((F.col("_i") - 1) * (n - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    return df.where((F.col("_n") <= n) | (F.col("_i") == 0) | (slot > before)).drop("_i", "_n")


def spectral_integrity(df: DataFrame, by: list[str], spectrum: str = "spectrum") -> DataFrame:
    bad = lambda f: F.sum(F.size(F.filter(spectrum, f)))
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(F.size(spectrum)).alias("n_values"), bad(lambda x: F.isnan(x)).alias("n_nan"), bad(lambda x: F.abs(x) == float("inf")).alias("n_inf"))


def pixel_quality(df: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    s = F.col(spectrum)
    n_zero = F.size(F.filter(s, lambda x: x == 0))
    return df.withColumns({"n_zero": n_zero, "n_nonpositive": F.size(F.filter(s, lambda x: x <= 0)), "zero_fraction": n_zero / F.size(s), "min_reflectance": F.array_min(F.filter(s, lambda x: ~F.isnan(x)))})


def band_quality(df: DataFrame, spectrum: str = "spectrum", last: int = 5) -> DataFrame:
    """Counts, their rates and low quantiles per band over rows that are not all zero; one of the last bands fails on a
    negative."""
    rows = df.where(~F.forall(spectrum, lambda x: F.abs(x) <= 1e-12)).select(F.size(spectrum).alias("n_bands"), F.posexplode(spectrum).alias("band", "v"))
    out = rows.groupBy("band", "n_bands").agg(F.count("*").alias("n"), F.count_if(F.col("v") < 0).alias("n_negative"), F.count_if(F.col("v") == 0).alias("n_zero"), F.count_if(F.col("v") <= 0).alias("n_nonpositive"), F.min("v").alias("least"), F.percentile("v", 0.01).alias("q01"), F.percentile("v", 0.001).alias("q001"))
    out = out.withColumns({f"{c}_rate": F.col(f"n_{c}") / F.col("n") for c in ("negative", "zero", "nonpositive")})
    return out.withColumn("failed", (F.col("band") >= F.col("n_bands") - last) & (F.col("n_negative") > 0)).drop("n_bands")


def robust_outliers(objects: DataFrame, by: list[str], key: str, spectrum: str = "spectrum", threshold: float = 6.0, eps: float = 1e-12) -> DataFrame:
    """Distance of an object: the median over bands of |x - group median| / group MAD (0 or infinite where MAD is 0)."""
    long = objects.select(*by, key, F.posexplode(spectrum).alias("band", "v"))
    centre = long.groupBy(*by, "band").agg(F.percentile("v", 0.5).alias("centre"))
    gaps = join_same(long, centre, [*by, "band"]).withColumn("gap", F.abs(F.col("v") - F.col("centre")))
    mad = gaps.groupBy(*by, "band").agg(F.percentile("gap", 0.5).alias("mad"))
    ratio = F.when(F.col("mad") > eps, F.col("gap") / F.col("mad")).when(F.col("gap") <= eps, 0.0).otherwise(float("inf"))
    out = join_same(gaps, mad, [*by, "band"]).groupBy(*by, key).agg(F.percentile(ratio, 0.5).alias("distance"))
    return out.withColumn("outlier", F.col("distance") > threshold)


def nearest_box(boxes: DataFrame, image: str, key: str) -> DataFrame:
    """Distance of each bounding box to the nearest other box of its image; infinite for a single one."""
    return nearest.nearest(boxes, image, key).drop("nearest_key")
