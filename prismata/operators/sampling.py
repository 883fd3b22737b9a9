"""Observation matrices by name, their samples, contracts and feasibility. Orders are hashes, so samples repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismata.functions import spectra as sp
from prismata.operators import factor
from prismata.operators.matrices import object_matrix
from prismata.plans.nulls import join_same


def hash_order(seed: Column, *parts: str) -> Column:
    """A text that orders rows at random, but always alike."""
    return F.md5(F.concat_ws(":", seed.cast("string"), *[F.col(p).cast("string") for p in parts]))


def all_pixels(pixels: DataFrame, objects: DataFrame, key: str, spectrum: str = "spectrum") -> DataFrame:
    """Every valid pixel with its object's columns."""
    return pixels.where(sp.validity_reason(F.col(spectrum)) == "valid").join(objects, key)


def centre_distance(pixels: DataFrame, by: list[str]) -> DataFrame:
    """``centre_distance``: from each pixel to the centroid of its object."""
    centre = pixels.groupBy(*by).agg(F.avg("row").alias("_r"), F.avg("col").alias("_c"))
    return join_same(pixels, centre, by).withColumn("centre_distance", F.hypot(F.col("row") - F.col("_r"), F.col("col") - F.col("_c"))).drop("_r", "_c")


def draw(pixels: DataFrame, by: list[str], m: int, order: list, policy: str = "short") -> DataFrame:
    """``m`` pixels per object in the given order, with ``draw``, ``n_available`` and ``status``. An object with fewer:
    ``short`` keeps what there is, ``exclude`` drops it, ``replace`` goes through its pixels again, ``error`` is one."""
    if policy not in ("short", "exclude", "replace", "error"):
        raise ValueError(policy)
    w = Window.partitionBy(*by)  # an object's pixels
    df = pixels.withColumns({"draw": F.row_number().over(w.orderBy(*order)), "n_available": F.count("*").over(w)})
    short = F.col("n_available") < m
    df = df.withColumn("status", F.when(~short, "complete").otherwise({"short": "short", "exclude": "excluded", "replace": "replaced", "error": "error"}[policy]))
    if policy == "replace":
        turns = F.sequence(F.lit(0), F.floor((F.lit(m) - F.col("draw")) / F.col("n_available")).cast("int"))
        return df.where(F.col("draw") <= m).withColumn("_t", F.explode(turns)).withColumn("draw", (F.col("draw") + F.col("_t") * F.col("n_available")).cast("int")).drop("_t")
    if policy == "error":
        df = df.withColumn("draw", F.when(short, F.raise_error(F.lit("an object has too few pixels"))).otherwise(F.col("draw")))
    return df.where((F.col("draw") <= m) & (~short | F.lit(policy != "exclude")))


def selection_diagnostics(pixels: DataFrame, drawn: DataFrame, by: list[str], pixel: str, valid: Column) -> DataFrame:
    """Per object raw, valid, invalid and selected pixels, and a hash of the selection (of m pixels at most)."""
    raw = pixels.groupBy(*by).agg(F.count("*").alias("n_raw"), F.count_if(valid).alias("n_available"))
    chosen = drawn.groupBy(*by).agg(F.count("*").alias("n_selected"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(pixel))), ","), 256).alias("selection_hash"), F.max("status").alias("status"))
    return join_same(raw, chosen, by, "left").withColumn("n_invalid", F.col("n_raw") - F.col("n_available")).fillna(0, ["n_selected"]).fillna("none", ["status"])


# fixed values: names of matrix methods and their families
FAMILIES = {"object_mean": "object_matrix", "object_median": "object_matrix", "balanced_pixels": "pixel_matrix", "all_pixels": "pixel_matrix", "pixel": "pixel_matrix"}


def build_matrix(pixels: DataFrame, method: str, keys: list[str], pixel: str, m: int = 40, seed: int = 42, strategy: str = "random", policy: str = "short", spectrum: str = "spectrum") -> DataFrame:
    """``(keys, spectrum)`` rows of a matrix by its name; pixel levels keep the pixel. Only valid pixels count."""
    if method not in FAMILIES:
        raise ValueError(f"unknown matrix method: {method}")
    rows = pixels.where(sp.validity_reason(F.col(spectrum)) == "valid")
    if method in ("object_mean", "object_median"):
        out = object_matrix(rows, keys, spectrum, median=method == "object_median")
    elif method == "balanced_pixels":
        if strategy == "center":
            rows, order = centre_distance(rows, keys), ["centre_distance", pixel]
        else:
            order = [hash_order(F.lit(seed), *keys, pixel), pixel]
        out = draw(rows, keys, m, order, policy).select(*keys, pixel, spectrum)
    else:
        out = rows.select(*keys, pixel, spectrum)
    return out.withColumns({"matrix_method": F.lit(method), "matrix_family": F.lit(FAMILIES[method])})


def matrix_rank(matrix: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """One row: numerical ``matrix_rank`` and ``rank_ratio`` to the shorter side; both NULL where rows differ in length or a
    value is not finite, and without rows."""
    found = factor.ranks(factor.factors(matrix.withColumn("_w", F.size(spectrum)), "_w", spectrum))  # a row a length
    one = F.count("*") == 1
    return found.agg(F.when(one, F.max("rank")).alias("matrix_rank"), F.when(one, F.max(F.col("rank") / F.least("n", "width"))).alias("rank_ratio"))


def matrix_summary(matrix: DataFrame, label: str, image: str, spectrum: str = "spectrum", eps: float = 1e-12) -> DataFrame:
    """One row: rows, bands, classes, images, values that are not finite, bands without variance, rank, and ``status``: accepted
    with rows, finite values and two classes or more."""
    one = matrix.agg(F.count("*").alias("n_rows"), F.min(F.size(spectrum)).alias("n_bands"), F.max(F.size(spectrum)).alias("most_bands"), F.count_distinct(label).alias("n_classes"), F.count_distinct(image).alias("n_images"), F.sum(F.size(F.filter(spectrum, lambda x: ~sp.finite(x)))).alias("n_non_finite"))
    bands = matrix.select(F.posexplode(spectrum).alias("band", "v")).groupBy("band").agg(F.var_pop("v").alias("v"))
    one = one.crossJoin(bands.agg(F.avg((F.col("v") <= eps).cast("double")).alias("zero_variance_rate"), F.count_if(F.col("v") <= eps).alias("n_zero_variance_bands")))  # one row each
    good = (F.col("n_rows") > 0) & (F.col("n_bands") > 0) & (F.col("n_non_finite") == 0) & (F.col("n_classes") >= 2)
    return one.crossJoin(matrix_rank(matrix, spectrum)).withColumn("status", F.when(good, "accepted").otherwise("invalid"))


SPATIAL = ("row", "col", "pixel_index")


def matrix_contract(matrix: DataFrame, label: str, image: str, key: str, classes: list[str], objects: DataFrame, spectrum: str = "spectrum", level: str | None = None, spatial: tuple[str, ...] = SPATIAL) -> DataFrame:
    """Checks of a matrix, one row each with what breaks it: no rows, ragged bands, values that are not finite, bands
    without variance, rank 0, classes that are missing or not expected, objects that are not expected; with a ``level``, spatial
    columns that a pixel matrix lacks or an object matrix has."""
    s = matrix_summary(matrix, label, image, spectrum)
    found = matrix.select(F.col(label).cast("string").alias("c")).distinct().agg(F.collect_set("c").alias("found"))  # classes are few
    strange = matrix.select(key).distinct().join(objects.select(key), key, "left_anti").agg(F.count("*").alias("strange"))
    wanted = F.array(*map(F.lit, classes))
    one = s.crossJoin(found).crossJoin(strange)
    rows = [
        ("not_empty", F.when(F.col("n_rows") == 0, 1).otherwise(0)),
        ("aligned", F.when(F.col("n_bands") == F.col("most_bands"), 0).otherwise(1)),
        ("finite", F.col("n_non_finite")),
        ("varying_bands", F.col("n_zero_variance_bands")),
        ("rank_above_zero", F.when(F.col("matrix_rank") > 0, 0).otherwise(1)),
        ("classes_present", F.size(F.array_except(wanted, "found"))),
        ("classes_expected", F.size(F.array_except("found", wanted))),
        ("two_classes", F.when(F.col("n_classes") >= 2, 0).otherwise(1)),
        ("objects_expected", F.col("strange")),
    ]
    if level:
        there = set(spatial) & set(matrix.columns)
        rows.append(("spatial_columns", F.lit(len(set(spatial) - there) if level in ("pixel", "balanced_pixel") else len(there))))
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), c.cast("long").alias("n_broken")) for n, c in rows])).alias("x")).select("x.*").withColumn("passed", F.coalesce(F.col("n_broken"), F.lit(0)) == 0)


def feasibility_grid(objects: DataFrame, label: str, image: str, n: str, sizes: list[int], least: float = 0.9) -> DataFrame:
    """``objects`` with their number of valid pixels: per m how many objects reach it, rows and balance of classes and images
    when each gives min(m, n), and accepted where enough objects do. Counts per object decide, so no pixel is read again."""
    grid = objects.select(label, image, n, F.explode(F.array(*map(F.lit, sizes))).alias("m")).withColumn("take", F.least(F.col(n), F.col("m")))
    base = grid.groupBy("m").agg(F.count("*").alias("n_objects"), F.avg((F.col(n) >= F.col("m")).cast("double")).alias("eligible_rate"), F.sum("take").alias("n_rows"))
    for name, column in (("class", label), ("image", image)):
        per = grid.groupBy("m", column).agg(F.sum("take").alias("k")).where("k > 0").groupBy("m").agg((F.min("k") / F.max("k")).alias(f"{name}_balance_ratio"), F.count("*").alias(f"n_{name}_groups"))
        base = base.join(per, "m")
    return base.withColumn("status", F.when(F.col("n_class_groups") < 2, "invalid").when(F.col("eligible_rate") >= least, "accepted").otherwise("too_few_eligible"))


def minhash_sketch(rows: DataFrame, by: list[str], ident: Column, n: int = 8) -> DataFrame:
    """``n`` minima of salted SHA-256 (first 16 hex digits) per group, comma-joined; map-side combined minima."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt")
    each = rows.select(*by, ident.alias("_id"), salts).groupBy(*by, "salt").agg(F.min(F.substring(F.sha2(F.concat_ws("|", F.col("salt").cast("string"), "_id"), 256), 1, 16)).alias("h"))
    return each.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("salt", "h"))), lambda x: x["h"]), ",").alias("sketch"))


def stratified(df: DataFrame, by: list[str], n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows at most of each group, in hash order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(hash_order(F.lit(seed), key), key))).where(F.col("_r") <= n).drop("_r")


def annotation_subset(images: DataFrame, strata: list[str], fraction: float, seed: int, key: str) -> DataFrame:
    """max(1, ceil(fraction n)) images of each stratum. A column that names predictions or scores is an error."""
    bad = [c for c in images.columns if "pred" in c.lower() or "score" in c.lower()]
    if bad:
        raise ValueError(f"predictions must not steer annotation: {bad}")
    w = Window.partitionBy(*strata)
    df = images.withColumns({"_r": F.row_number().over(w.orderBy(hash_order(F.lit(seed), key), key)), "_n": F.count("*").over(w)})
    return df.where(F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * fraction))).drop("_r", "_n")


def keep_chosen(sampled: DataFrame, all_rows: DataFrame, chosen: DataFrame, key: list[str]) -> DataFrame:
    """A sample and, besides, every chosen row; each row once."""
    return sampled.unionByName(all_rows.join(chosen.select(*key).distinct(), key, "left_semi")).dropDuplicates(key)
